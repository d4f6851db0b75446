"""Quality classifier: text measures scored by an additive model."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlab.llm import additive
from screenlab.llm.common import fold, tidy
from screenlab.llm.rules import STOP_WORDS

#: Labelled rows a model is fitted on at most: those with the smallest id hashes.
SAMPLE = 30_000

FEATURES = (
    "letters", "word_length", "upper", "digits", "symbols", "exclamations", "stops", "distinct", "top_word",
    "echoes", "line_words", "repeated_lines", "function_words", "lone_marks", "beyond_ascii",
)

_FUNCTION_WORDS = frozenset({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
_UPPER = np.arange(65, 91)
_DIGITS = np.arange(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def measured(text: str | None) -> list[float]:
    """The features of one whole text; null and wordless texts have zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    echoes = sum(map(str.__eq__, words, words[1:]))
    marks = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    return [
        float(np.log1p(len(text))),
        sum(map(len, words)) / n,
        seen[_UPPER].sum() / len(raw),
        seen[_DIGITS].sum() / len(raw),
        seen[_SYMBOLS].sum() / n,
        seen[33] / n,
        seen[_STOPS].sum() / n,
        len(counts) / n,
        max(counts.values()) / n,
        echoes / n,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(counts[w] for w in _FUNCTION_WORDS if w in counts) / n,
        marks / n,
        seen[128:].sum() / len(raw),
    ]


@tidy
def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measured(t.as_py()) for t in batch.column(1)]
        columns = [pa.array(rows, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_key", "_x"])


@tidy
def _scored(model, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).field(text_col).cast(pa.string())
        rows = [measured(t.as_py()) for t in texts]
        scores = model.value.score(np.array(rows).reshape(-1, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_row", "_score"])


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_key, _x): id and feature vector of each row."""
    schema = T.StructType(
        [T.StructField("_key", docs.schema[id_col].dataType), T.StructField("_x", T.ArrayType(T.DoubleType()))]
    )
    return docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).mapInArrow(_table, schema)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> additive.AdditiveModel:
    """Learn from labelled rows outside the held-out fold, at most `sample` of them.

    Only features and labels of the sample reach the driver. Rows without id,
    and labels that are null, teach nothing; an id with several labels or rows
    teaches once, its smallest label and features.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 1)).groupBy(F.col(id_col).alias("_key"))
    known = known.agg(F.min(label_col).cast("double").alias("_y"))
    # Ids with hashes up to here are about as many as the sample may hold.
    share = min(1.0, sample / max(1, known.count()))
    last = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    taught = docs.filter((fold(F.col(id_col)) != 1) & (F.xxhash64(id_col) <= F.lit(last)))
    taught = features(taught, id_col, text_col)
    rows = (
        taught.join(known, "_key")
        .groupBy("_key")
        .agg(F.min("_x").alias("_x"), F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(sample)
        .collect()
    )
    x = np.array([r["_x"] for r in rows], float).reshape(-1, len(FEATURES))
    return additive.fit(x, np.array([r["_y"] for r in rows], float))


def score_quality(docs: DataFrame, model: additive.AdditiveModel, text_col: str = "text") -> DataFrame:
    """(row, score, predicted): each input row as a struct, how likely it is good, and 1 from one half.

    Every row is scored by itself in a narrow map, whole texts, with a model of
    bounded size. Null and empty texts get the score of zero features. The row
    stays in its struct, so no column name can clash; an empty table gives none.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("_row"))
    schema = T.StructType([given.schema["_row"], T.StructField("_score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = given.mapInArrow(functools.partial(_scored, sent, text_col), schema)
    predicted = (F.col("_score") >= 0.5).cast("int")
    return out.select(F.col("_row").alias("row"), F.col("_score").alias("score"), predicted.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject."""
    found = score_quality(docs, fit_quality(docs, labels, **options))
    return found.filter("predicted = 1").select("row.*")
