"""Substring dedup by hashing normalised units of lines.

A unit is a sentence of a line.  Digests of all units meet once, the earliest
ranked occurrence of each stays, and runs of later occurrences that are long
enough are cut out of their texts, with the offsets they had.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of repeated units goes when it has this many words.
RUN_WORDS = 25
#: Rows in one batch out of a task; ten times as many digests are held before they leave.
HELD = 50_000

_UNIT = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")


def units_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of each unit with a word; a unit never spans lines."""
    out = []
    for m in _UNIT.finditer(text):
        words = m.group().lower().split()
        if words:
            out.append((m.start(), m.end(), words))
    return out


_UNITS = pa.schema(
    [
        ("_d1", pa.int64()),
        ("_d2", pa.int64()),
        ("_id", pa.int64()),
        ("_hash", pa.int64()),
        ("_unit", pa.int32()),
        ("_later", pa.bool_()),
    ]
)


def _digests(id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a task: the earliest of each digest, and apart from them the later ones.

    The later ones are settled here and get a digest of their own place, so a
    unit that a third of all rows hold leaves the task as one row to be compared.
    """
    schema = _UNITS.set(2, pa.field("_id", id_type))
    earliest: dict[bytes, tuple] = {}
    later: list[tuple] = []

    def rows(digests: list[bytes], found: list[tuple], settled: bool) -> pa.RecordBatch:
        ids, hashes, numbers = zip(*found, strict=True) if found else ((), (), ())
        halves = [[int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests] for k in (0, 8)]
        columns = [*halves, ids, hashes, numbers, [settled] * len(found)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
        )

    def settled() -> pa.RecordBatch:
        return rows([_digest(repr(x)) for x in later], later, True)

    def compared() -> Iterator[pa.RecordBatch]:
        digests = list(earliest)
        for k in range(0, len(digests), HELD):
            part = digests[k : k + HELD]
            yield rows(part, [earliest[d] for d in part], False)

    for batch in batches:
        for i, h, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            for n, (_, _, words) in enumerate(units_of(text)):
                new = (i, h, n)
                old = earliest.setdefault(_digest(" ".join(words)), new)
                if old != new:
                    if _rank(new) < _rank(old):
                        earliest[_digest(" ".join(words))], new = new, old
                    later.append(new)
            if len(later) > HELD:
                yield settled()
                later = []
            if len(earliest) > 10 * HELD:
                yield from compared()
                earliest = {}
    yield settled()
    yield from compared()


def _digest(x: str) -> bytes:
    return hashlib.blake2b(x.encode(), digest_size=16).digest()


def _rank(x: tuple) -> tuple:
    """Null ids come first, as in Spark's order."""
    return (x[0] is not None, x[0] if x[0] is not None else 0, *x[1:])


def _cut(run_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: row, text, repeated units. Adds the spans cut out and the text left."""
    for batch in batches:
        spans, kept = [], []
        for text, repeated in zip(batch.column(1), batch.column(2), strict=True):
            text, cuts = text.as_py(), []
            if repeated.as_py():
                units, run, words, last = units_of(text), [], 0, None
                for n in [*sorted(repeated.as_py()), None]:
                    if n is None or last is None or n != last + 1:
                        if words >= run_words:
                            cuts.append((units[run[0]][0], units[run[-1]][1]))
                        run, words = [], 0
                    if n is not None:
                        run.append(n)
                        words += len(units[n][2])
                    last = n
            spans.append([{"start": a, "end": b} for a, b in cuts])
            for a, b in reversed(cuts):
                text = text[:a] + text[b:]
            kept.append(text)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), pa.array(spans, kind)], names=["_row", "_text", "_spans"]
        )


def find_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS
) -> DataFrame:
    """(row, text, spans): the input row as a struct, its text without repeats, and where they were.

    Occurrences are ranked by id (null first), then by the text's hash, then by
    place. Units are compared in lower case with white space made even. Of each
    unit the earliest occurrence stays whatever its length; consecutive later
    ones go if together they have `run_words` words. Offsets count characters of
    the original text. A null text stays null, an empty one empty, both without
    spans. Rows equal in id and text are one document and fare alike. Other
    columns ride along in the struct, so their names cannot clash.

    Digests have 128 bits. A task sends one row for each unit it holds, however
    often, and the window over a digest sees at most one row of each task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(
        row.alias("_row"),
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_hash"),
        F.col(text_col).alias("_text"),
    )
    id_type = pa.string() if isinstance(docs.schema[id_col].dataType, T.StringType) else pa.int64()
    if not isinstance(docs.schema[id_col].dataType, T.StringType):
        given = given.withColumn("_id", F.col("_id").cast("long"))
    schema = T.StructType(
        [
            T.StructField("_d1", T.LongType()),
            T.StructField("_d2", T.LongType()),
            T.StructField("_id", given.schema["_id"].dataType),
            T.StructField("_hash", T.LongType()),
            T.StructField("_unit", T.IntegerType()),
            T.StructField("_later", T.BooleanType()),
        ]
    )
    units = (
        given.select("_id", "_hash", "_text")
        .filter(F.col("_text") != "")
        .mapInArrow(functools.partial(_digests, id_type), schema)
    )
    # One digest meets itself: rows of the same unit of equal rows are equal and all stay.
    digest = Window.partitionBy("_d1", "_d2")
    rank = F.struct("_id", "_hash", "_unit")
    units = units.withColumn("_first", F.min(rank).over(digest))
    settled = units.filter(F.col("_later") | ~F.col("_first").eqNullSafe(rank))
    by_row = settled.groupBy("_id", "_hash").agg(F.collect_set("_unit").alias("_repeated"))
    by_row = by_row.withColumnsRenamed({"_id": "_rid", "_hash": "_rhash"})
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_hash") == F.col("_rhash"))
    joined = given.join(by_row, same, "left").select("_row", "_text", "_repeated")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([joined.schema["_row"], joined.schema["_text"], T.StructField("_spans", spans)])
    cut = joined.mapInArrow(functools.partial(_cut, run_words), out)
    return cut.select(F.col("_row").alias("row"), F.col("_text").alias("text"), F.col("_spans").alias("spans"))


def without_repeats(docs: DataFrame, text_col: str = "text", n_chars: str | None = None, **options: object) -> DataFrame:
    """The rows of `docs` with repeats cut out of their texts; n_chars, if named, is counted anew."""
    found = find_repeats(docs, text_col=text_col, **options)

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("text").alias(name)
        if name == n_chars:
            return F.length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return found.select(*map(column, docs.columns))
