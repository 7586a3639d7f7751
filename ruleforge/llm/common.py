"""What the corpus operators share: the shared folder, staged tables, two-level running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract in this package: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by folder and name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the session has set.

    Where neither is set: a temporary folder if driver and executors are one process, else one in the home of the
    default file system; an error where that is a machine's own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] == "local":
            named = "file://" + tempfile.mkdtemp(prefix="ruleforge-")
        else:
            home = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration()).getHomeDirectory()
            if home.toUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = f"{home}/.ruleforge-{uuid.uuid4().hex}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and is computed once. Goes when the JVM ends.

    release: the driver collects its garbage, on which Spark removes the shuffle files that the table came from.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if release:
        spark.range(1).write.format("noop").mode("overwrite").save()  # Spark holds the last job's plan until the next one
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def beside(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A staged table for the right side of a join: broadcast if it has few rows, else merged.

    Spark alone goes by an estimate of bytes, which knows neither how far a file is compressed nor how many rows a
    function of Python makes of one, and the driver holds what is broadcast.
    """
    return table.hint("broadcast" if table.count() <= most else "merge")


def text_of(column: str = "text") -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(column), F.lit(""))


def fit_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones can't clash with those that an operator adds."""
    return df.select(*names)


def running_start(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all rows before this one, within keys, ordered by (bucket, *order).

    Works on two levels, bucket totals and then rows inside a bucket, so that no task sees all rows of a hot key.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    joined = df.join(starts, [df[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)] + [df[bucket] == starts["_b"]])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start", "_b", *[f"_k{i}" for i in range(len(keys))])
