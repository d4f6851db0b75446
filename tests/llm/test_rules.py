import re
import time

from pyspark.sql import functions as F

from screenlab.llm.rules import RULES, judge


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(hit) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_counts_equal_brute_force(odd, odd_rows):
    got = judge(odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    key = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *brute(t)) for i, t in odd_rows), key=key)


def test_overlapping_repeats(spark):
    text = " ".join(["a b c"] * 10 + [f"w{k}" for k in range(30)] + ["p q r s t u v w x"] * 2)
    row = judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == brute(text)[4] == 30 + 18


def test_broken_rules_are_named_and_no_python_runs(spark, capsys):
    clean = " ".join(["the house of the king is in the old town and it was"] + [f"word{k}" for k in range(40)])
    junk = " ".join(f"w{k}***" for k in range(40))
    df = judge(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).orderBy("doc_id")
    good, bad = df.collect()
    assert good["kept"] and good["broken"] == []
    assert not bad["kept"] and "symbols" in bad["broken"]
    df.explain()
    assert not re.search("Python|Arrow|Exchange hash", capsys.readouterr().out)


def test_rules_may_be_given(odd):
    strict = judge(odd, rules=(*RULES, RULES[0]._replace(name="long", value="n_words", low=10_000.0)))
    assert strict.filter("kept").count() == 0


def test_empty_table(none):
    assert judge(none).filter(F.col("kept")).count() == 0


def test_a_filter_gives_the_rows_that_are_kept(spark, sf):
    judged = judge(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = [r["doc_id"] for r in judged.collect() if r["kept"]]
    start = time.time()
    assert sorted(r["doc_id"] for r in judged.filter("kept AND NOT base_failed").collect()) == sorted(kept)
    assert time.time() - start < 60
