"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these six ASCII characters separate words (fixed value).
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of the value, which is worked out once however often `use` names it.

    An expression named inside the function of a higher-order one is otherwise
    worked out for every element, and once more for every mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(key: Column) -> Column:
    """crc32 of the id written as text, modulo three; the contract's held-out rows have 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def tidy(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """`work` for a task's batches, which at its end gives freed memory back to the system.

    Workers are used again by later stages, which would otherwise start with the
    most that an earlier one has held.
    """

    @functools.wraps(work)
    def run(*given: object) -> Iterator:
        try:
            yield from work(*given)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach, under spark.checkpoint.dir.

    Only a local session that doesn't set it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"llm-{uuid.uuid4().hex}")


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame as a table in the folder: read again without its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
