"""Event records from files: JSON (lines or whole documents), Parquet, CSV and what else Spark reads, with where each came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flatten import flatten_events

CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str | list[str], kind: str = "json", schema: T.StructType | str | None = None) -> DataFrame:
    """Records with source_file and _record (a number by file and place). Those that don't parse are left out.

    kind: a format of spark.read. A schema saves the pass that infers one, and is needed where files may be empty.
    Nested log records (an Event column with System and EventData) are flattened.
    """
    reader = spark.read.format(kind)
    if kind == "json":
        reader = reader.option("mode", "DROPMALFORMED")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path).select("*", F.col("_metadata.file_path").alias("source_file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("_record"))
    if CORRUPT in df.columns:
        df = df.drop(CORRUPT)
    if "Event" in df.columns and isinstance(df.schema["Event"].dataType, T.StructType):
        df = flatten_events(df.select(F.struct("Event").alias("raw"), "source_file", "_record"), "raw", ["source_file", "_record"])
    return df
