"""Windowed aggregates of conditions as window plans: a value for each event that the search matches.

count, sum and avg are the two-bucket estimate, or exact trailing ranges; count(field), min and max are exact. The
range is [t - window, t] with both ends. All of them are partitioned by group and bucket of time, so that neither a hot
group nor a rule without groups ends in one task.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleforge.functions.comparators import Value
from ruleforge.rules.condition import Aggregate

from .options import Options
from .search import Compiler

#: Buckets count from year 1, not from 1970.
EPOCH = 62_135_596_800_000_000
TESTS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def number_of(v: Value) -> Column:
    """The argument of a numeric aggregate; null where it is no number."""
    return v.col.cast("double") if isinstance(v.kind, T.NumericType) else v.text.try_cast("double")


def aggregate_input(agg: Aggregate, base: Column, compiler: Compiler) -> tuple[Column, Column, str]:
    """Whether an event is counted, the argument of the function, and the function; count over a field is `distinct`."""
    hit = F.coalesce(base, F.lit(False))
    if agg.func == "count":
        return (hit, F.coalesce(compiler.fields.direct(agg.field).text, F.lit("<nil>")), "distinct") if agg.field else (hit, F.lit(1.0), "count")
    arg = number_of(compiler.fields.direct(agg.field))
    return hit & arg.isNotNull(), arg, agg.func


def add_aggregate(df: DataFrame, base: Column, agg: Aggregate, window: int, compiler: Compiler, options: Options, out: str) -> DataFrame:
    """Adds out: whether the event matches base and the aggregate over its group passes the threshold.

    Needs the columns _us and _seq. An own aggregator is a function (df, agg, window, group columns) -> df that adds
    the column _value to a frame with _hit (whether base matches) and, where the function has a field, _arg.
    """
    groups = [f"_g{i}" for i in range(len(agg.group))]
    hit, arg, func = aggregate_input(agg, base, compiler)
    names = df.columns
    df = df.withColumns({g: compiler.fields.direct(name).col for g, name in zip(groups, agg.group, strict=True)} | {"_hit": hit, "_arg": arg})
    if func in options.aggregators:
        df = options.aggregators[func](df, agg, window, groups)
    elif func in ("distinct", "min", "max"):
        df = _ranged(df, func, window, groups)
    else:
        df = (_exact if options.window_mode == "exact" else _estimate)(df, func, window, groups)
    return df.withColumn(out, F.coalesce(F.col("_hit") & TESTS[agg.op](F.col("_value"), float(agg.threshold)), F.lit(False))).select(*names, out)


def _bucketed(df: DataFrame, window: int) -> DataFrame:
    """Each row in the bucket of its time and, as one that only others see, in the next: the rows of [t - window, t] meet in t's bucket.

    A hot group, or a rule without groups, is so cut along time. Rows of which _own is false have only what frames read.
    """
    kept = {"_hit", "_arg", "_us", "_seq"} | {c for c in df.columns if c.startswith("_g")}
    bucket = F.expr(f"(_us + {EPOCH}) div {window + 1}")
    both = df.withColumn("_two", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))))
    both = both.where("_two.own OR _hit")
    return both.select(*[F.col(f"`{c}`") if c in kept else F.when(F.col("_two.own"), F.col(f"`{c}`")).alias(c) for c in df.columns], F.col("_two.b").alias("_in"), F.col("_two.own").alias("_own"))


def _ranged(df: DataFrame, func: str, window: int, groups: list[str]) -> DataFrame:
    df = _bucketed(df, window)
    if func == "distinct":
        return _distinct(df, window, groups)
    trailing = Window.partitionBy(*groups, "_in").orderBy("_us").rangeBetween(-window, 0)
    return df.withColumn("_value", (F.min if func == "min" else F.max)(F.when(F.col("_hit"), F.col("_arg"))).over(trailing)).where("_own")


def _distinct(df: DataFrame, window: int, groups: list[str]) -> DataFrame:
    """Different values in [t - window, t] as a running sum: a value counts from an occurrence until it was not seen for the window.

    An occurrence adds 1 unless the value was seen within the window before it, and one that isn't followed by another
    within the window takes 1 away right after it. No frame is evaluated anew for each row.
    """
    hits = df.where("_hit")
    same = Window.partitionBy(*groups, "_in", "_arg").orderBy("_us", "_seq")
    hits = hits.withColumns({"_last": F.lag("_us").over(same), "_next": F.lead("_us").over(same)})
    hits = hits.withColumn("_step", F.when(F.col("_last") >= F.col("_us") - window, 0).otherwise(1))
    gone = F.when(F.col("_next").isNull() | (F.col("_next") > F.col("_us") + window), F.struct((F.col("_us") + window + 1).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("real")))
    both = hits.withColumn("_e", F.explode(F.array_compact(F.array(F.struct(F.col("_us").alias("at"), F.col("_step").alias("step"), F.lit(True).alias("real")), gone))))
    running = Window.partitionBy(*groups, "_in").orderBy("_e.at").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_value", F.sum("_e.step").over(running).cast("double")).where("_own AND _e.real").drop("_last", "_next", "_step", "_e")
    others = df.where("_own AND NOT _hit").withColumn("_value", F.lit(None).cast("double"))
    return counted.unionByName(others)


def _exact(df: DataFrame, func: str, window: int, groups: list[str]) -> DataFrame:
    trailing = Window.partitionBy(*groups, "_in").orderBy("_us").rangeBetween(-window, 0)
    arg = F.when(F.col("_hit"), F.col("_arg"))
    return _bucketed(df, window).withColumn("_value", {"count": F.count, "sum": F.sum, "avg": F.avg}[func](arg).over(trailing).cast("double")).where("_own")


def _estimate(df: DataFrame, func: str, window: int, groups: list[str]) -> DataFrame:
    """The last bucket's total by the share of it that the window still covers, and this bucket's running total."""
    keys = [*groups, "_bucket"]
    df = df.withColumn("_bucket", F.expr(f"(_us + {EPOCH}) div {window}"))
    arg = F.when(F.col("_hit"), F.col("_arg"))
    totals = df.where("_hit").groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n0"), F.sum("_arg").alias("_s0") if func != "count" else F.lit(0.0).alias("_s0"))
    totals = totals.select(*[F.col(k).alias(f"_l{k}") for k in groups], (F.col("_bucket") + 1).alias("_l_bucket"), "_n0", "_s0")
    running = Window.partitionBy(*keys).orderBy("_us", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n1", F.count(arg).over(running).cast("double"))
    if func != "count":
        df = df.withColumn("_s1", F.coalesce(F.sum(arg).over(running), F.lit(0.0)))
    on = [df[g].eqNullSafe(totals[f"_l{g}"]) for g in groups] + [df["_bucket"] == totals["_l_bucket"]]
    df = df.join(totals, on, "left")
    share = (F.lit(window) - (F.col("_us") + EPOCH - F.col("_bucket") * window)) / float(window)
    count = F.coalesce(F.col("_n0"), F.lit(0.0)) * share + F.col("_n1")
    if func == "count":
        return df.withColumn("_value", count)
    total = F.coalesce(F.col("_s0"), F.lit(0.0)) * share + F.col("_s1")
    return df.withColumn("_value", total if func == "sum" else F.when(count != 0, total / count))
