import hashlib
import struct
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
import test_decontaminate  # noqa: E402
import test_jaccard  # noqa: E402
import test_repeats  # noqa: E402
from screenlab.llm import queries  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage was given and made."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet").persist(), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf).persist()
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_copies", "repeats", "benchmarks", "tokens"]
    for _, _, made in stages[:-1]:
        assert made.columns == COLUMNS
        assert made.filter("n_chars <> length(text)").count() == 0


def test_quality_keeps_good_documents(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    _, docs, made = stages[0]
    known = docs.join(labels, "doc_id")
    kept = known.join(made.select("doc_id"), "doc_id", "left_semi")
    assert kept.filter("quality = 1").count() == known.filter("quality = 1").count()
    assert kept.filter("quality = 0").count() <= 0.2 * known.filter("quality = 0").count()


def test_each_stage_equals_brute_force(spark, sf, stages):
    _, docs, made = stages[1]
    assert sorted(i for i, _ in texts(made)) == sorted({c for _, n, c in test_jaccard.brute(texts(docs)) if n})
    _, docs, made = stages[2]
    assert sorted((str(i), t) for i, t in texts(made)) == [(i, t) for i, _, t in test_repeats.brute(texts(docs))]
    _, docs, made = stages[3]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [i for i, _, hit, _ in test_decontaminate.brute(texts(docs), items) if not hit]
    assert sorted(str(i) for i, _ in texts(made)) == clean


def test_tokens_decode_to_the_texts(stages):
    _, docs, made = stages[4]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(docs)}
    rows = made.collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == want
    assert all(r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(r['ids'])}I", *r["ids"])).hexdigest() for r in rows)


def test_run_is_the_chain_of_stages(spark, sf, stages):
    rows = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[4][2].collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    import compare

    assert compare.compare(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLES[name]) == []
