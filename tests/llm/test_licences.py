import re
import zlib

import pytest

from screenlab.llm import licences
from screenlab.llm.licences import fit, scan

LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
    "ALL RIGHTS RESERVED": "proprietary",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "The licence of the driver was revoked by the court.": None,
    "She asked for permission and the right to apply.": None,
    "Copyright law is a part of public law.": None,
    "Nothing of the kind.": None,
}


@pytest.fixture(scope="module")
def scanner(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def found(df):
    out = []
    for r in df.collect():
        out.append((r["row"]["doc_id"], [(x["line"], x["family"]) for x in r["found"]]))
    return sorted(out, key=str)


def test_lines_and_families(spark, scanner):
    text = "\n".join(LINES)
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")
    want = [(k, f) for k, f in enumerate(LINES.values()) if f]
    assert found(scan(df, scanner)) == sorted([(1, want), (1, want), (2, []), (3, [])], key=str)


def test_equals_plain_search_on_documents(spark, scanner):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = []
    for r in docs.collect():
        lines = enumerate(r["text"].split("\n"))
        want.append((r["doc_id"], [(k, LINES[x]) for k, x in lines if LINES.get(x)]))
    assert found(scan(docs, scanner)) == sorted(want, key=str)


def test_no_python_runs_and_nothing_is_shuffled(odd, none, scanner, capsys):
    df = scan(odd.select("doc_id", "text", "row"), scanner)
    assert df.count() == odd.count() and scan(none, scanner).count() == 0
    df.explain()
    assert not re.search("Python|Arrow|Exchange hash", capsys.readouterr().out)


BSD = """# Copyright (c) 2020, The Authors
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:"""
MIT = """Permission is hereby granted, free of
charge, to any person obtaining a copy
of this software and associated
documentation files (the "Software")"""


def test_wrapped_notices(spark, scanner):
    tight = BSD.replace("reserved.\n#\n", "reserved.\n")
    texts = [BSD, MIT, tight, "Some words.\n\n" + MIT + "\n\nThe end.", "It is now in the public\ndomain."]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: [(x["line"], x["last"], x["family"]) for x in r["found"]] for r in scan(df, scanner).collect()}
    assert (3, 5, "bsd") in got[0] and got[1] == [(0, 3, "mit")] and got[2] == [(0, 4, "bsd")]
    assert got[3] == [(2, 5, "mit")] and got[4] == [(0, 1, "public-domain")]


def test_time_follows_the_length_of_a_paragraph(spark, scanner):
    import time

    took = []
    for n in (4_000, 16_000):
        text = "the license of " + " ".join(f"word{k}" for k in range(n)) + "\nReleased under the MIT License."
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        scan(df, scanner).collect()
        start = time.time()
        rows = scan(df, scanner).collect()
        took.append(time.time() - start)
        assert [x["family"] for x in rows[0]["found"]] == ["mit"]
    assert took[1] < 8 * took[0] + 2


def test_every_line_of_every_document_teaches_the_unknown_class(spark):
    """2,000 documents: all their lines are counted, and one held-out line of any of them moves the threshold."""
    plain = ["The ship left the harbour.", "All of it was in the hold", "Copyright law is a part of it.", "", "a version of the rights"]
    rows = [(k, "\n".join(plain[: 1 + k % 5])) for k in range(2_000)]
    docs = spark.createDataFrame([*rows, (-1, None)], "doc_id long, text string").repartition(3)
    own = fit(docs)
    found = licences.background(docs, "text", own.vocabulary).collect()
    want = [x for _, t in rows for x in t.split("\n") if x and "Copyright" not in x]
    assert sum(r["n"] for r in found) == len(want) and len(found) <= 2 * 3
    assert own.threshold == 0.5
    line = next(x for k in range(99) if zlib.crc32((x := f"apache 2.0 x{k}").encode()) % 3 == 1)
    for at in (1_999,):
        more = [(k, t + "\n" + line if k == at else t) for k, t in rows]
        assert fit(spark.createDataFrame(more, "doc_id long, text string")).threshold > 0.55
