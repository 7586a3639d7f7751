"""Alert rows and their CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleforge.functions.gotext import go_text
from ruleforge.rules.model import Rule

# The columns of alert rows, in their order.
COLUMNS = ("timestamp", "source_file", "record_id", "computer", "channel", "event_id", "rule_id", "rule_title", "rule_level", "rule_tags", "event_json")


def guard_cell(c: Column) -> Column:
    """A cell that can't be taken for a formula."""
    return F.when(c.rlike("\\A[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def shown_time(df: DataFrame) -> Column:
    """TimeCreated: seconds as RFC 3339 in UTC with the figures that it has, anything else as it is."""
    if "TimeCreated" not in df.columns:
        return F.lit("")
    kind = df.schema["TimeCreated"].dataType
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return F.coalesce(go_text(F.col("TimeCreated"), kind), F.lit(""))
    t = F.timestamp_micros((F.col("TimeCreated") * 1_000_000).try_cast("bigint"))
    utc = F.to_utc_timestamp(t, F.current_timezone())
    return F.coalesce(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(utc, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z")), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_id and what alerts say of a rule: one row a rule."""
    rows = [(r.key, r.id, r.title, r.level, ";".join(r.tags)) for r in rules]
    return spark.createDataFrame(rows, "_rule string, rule_id string, rule_title string, rule_level string, rule_tags string")


def alerts(found: DataFrame, rules: list[Rule], source_file: str = "source_file", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Alert rows of detections (flat event columns and rule_id). ignore: columns that are no part of the event."""
    spark = found.sparkSession
    drop = {"rule_id", "group_values", source_file, *ignore}
    names = sorted(c for c in found.columns if c not in drop)
    record = F.col("EventRecordID").cast("string") if "EventRecordID" in found.columns else F.lit(None).cast("string")
    if "_record" in found.columns:
        record = F.coalesce(record, F.col("_record").cast("string"))
        names = [n for n in names if n != "_record"]

    def text(name: str) -> Column:
        return F.coalesce(go_text(F.col(f"`{name}`"), found.schema[name].dataType), F.lit("")) if name in found.columns else F.lit("")

    meta = F.broadcast(rule_table(spark, rules))  # one row a rule
    rows = found.select(
        shown_time(found).alias("timestamp"), (F.col(source_file) if source_file in found.columns else F.lit("")).alias("source_file"), F.coalesce(record, F.lit("")).alias("record_id"),
        text("Computer").alias("computer"), text("Channel").alias("channel"), text("EventID").alias("event_id"), F.col("rule_id").alias("_key"),
        F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("event_json"),
    )
    return rows.join(meta, F.col("_key") == F.col("_rule"), "left").select(*COLUMNS)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Alert rows as guarded CSV with a header."""
    rows.select(*[guard_cell(F.col(c)).alias(c) for c in rows.columns]).write.mode(mode).option("header", "true").option("escape", '"').csv(path)
