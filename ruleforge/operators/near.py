"""`search | near expression`: searches that matched not longer ago than the timeframe, without grouping.

The order is global, but no task sees all events: time is cut into buckets; inside a bucket a running last match is a
window, and the last match of earlier buckets is one small row a bucket, joined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleforge.rules.condition import Near, search_names

from .search import Compiler

DAY = 86_400_000_000


def add_near(df: DataFrame, base: Column, near: Near, timeframe: int, searches: dict[str, Column], compiler: Compiler, out: str) -> DataFrame:
    """Adds out: whether base matches and the near expression holds of recent matches, this event's included. Needs _us, _seq."""
    names, columns = [n for n in search_names(near.node, list(searches)) if n in searches], df.columns
    size = timeframe if timeframe > 0 else DAY
    df = df.withColumns({"_base": F.coalesce(base, F.lit(False)), "_bucket": F.floor(F.col("_us") / size)} | {f"_m{i}": F.coalesce(searches[n], F.lit(False)) for i, n in enumerate(names)})
    lasts = df.groupBy("_bucket").agg(*[F.max(F.when(F.col(f"_m{i}"), F.col("_us"))).alias(f"_p{i}") for i in range(len(names))], F.lit(1).alias("_one"))
    if timeframe > 0:
        before = lasts.withColumn("_for", F.col("_bucket") + 1)
    else:
        earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        before = lasts.select(F.col("_bucket").alias("_for"), *[F.max(f"_p{i}").over(earlier).alias(f"_p{i}") for i in range(len(names))])
    before = before.select("_for", *[f"_p{i}" for i in range(len(names))])
    running = Window.partitionBy("_bucket").orderBy("_us", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_r{i}": F.last(F.when(F.col(f"_m{i}"), F.col("_us")), ignorenulls=True).over(running) for i in range(len(names))})
    df = df.join(before, df["_bucket"] == before["_for"], "left")
    recent = {}
    for i, n in enumerate(names):
        last = F.coalesce(F.col(f"_r{i}"), F.col(f"_p{i}"))
        recent[n] = last.isNotNull() if timeframe <= 0 else F.coalesce(last >= F.col("_us") - timeframe, F.lit(False))
    return df.withColumn(out, F.col("_base") & F.coalesce(compiler.condition(near.node, recent), F.lit(False))).select(*columns, out)
