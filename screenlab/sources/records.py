"""Record files: gzip-compressed JSON lines, tolerant of missing and extra fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlab import schema


def typed_records(df: DataFrame, record: T.StructType) -> DataFrame:
    return df.select(*[schema.typed(f.name) for f in record])


def read_jsonl(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Unknown fields are dropped, absent ones take their defaults, blank lines are skipped."""
    return typed_records(spark.read.schema(record).json(path), record)


def parse_jsonl(lines: DataFrame, record: T.StructType) -> DataFrame:
    """The same for a frame of text lines in ``value``."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", record).alias("r"))
    return typed_records(parsed.select("r.*"), record)


def stamped(df: DataFrame, drop_fields: Sequence[str] = ()) -> DataFrame:
    """Rows as they are written: fields left out (not blanked) and the version stamp."""
    return df.drop(*drop_fields).withColumn("_v", F.lit(schema.RECORD_VERSION))


def write_jsonl(df: DataFrame, path: str, drop_fields: Sequence[str] = ()) -> None:
    stamped(df, drop_fields).write.mode("overwrite").json(path, compression="gzip")


def predictions(df: DataFrame, withheld: bool) -> DataFrame:
    """Prediction rows; the truth column is absent when it is withheld."""
    cols = ["target", "cell_line", "y_pred_proba"]
    return df.select(*cols) if withheld else df.select(*cols, "y_true")


def to_frame(df: DataFrame, record: T.StructType = schema.SCREEN_RECORD) -> DataFrame:
    return df.select(*record.fieldNames())


def sequence_map(text: DataFrame) -> DataFrame:
    """JSON objects {gene: [first, last]} in ``value`` as (target, first_seq, last_seq)."""
    parsed = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(parsed).alias("target", "s")).select(
        "target",
        F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first_seq"),
        F.coalesce(F.get("s", F.lit(1)), F.lit("")).alias("last_seq"),
    )


def write_run(
    folder: str,
    run_id: str,
    metrics: DataFrame,
    scores: DataFrame,
    info: DataFrame,
    predicted: DataFrame,
) -> None:
    """A run as four tables, each partitioned by run_id; a rerun replaces its own part."""
    for name, df in {
        "metrics": metrics,
        "cv_scores": scores,
        "run_info": info,
        "predictions": predicted,
    }.items():
        (
            df.withColumn("run_id", F.lit(run_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{folder}/{name}")
        )
