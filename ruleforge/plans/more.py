"""Further registered queries: sources and sinks, own functions, shared needles, streams. They join those of the catalogue."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleforge.functions.comparators import register_comparator, register_event_modifier
from ruleforge.functions.gotext import base64_text
from ruleforge.functions.patterns import escape_value
from ruleforge.operators.correlate import correlate
from ruleforge.operators.detect import Bundle, evaluate, match_column
from ruleforge.operators.options import Options
from ruleforge.operators.route import relevant
from ruleforge.rules.marshal import marshal_rule
from ruleforge.rules.reader import parse_config, parse_rule, split_documents
from ruleforge.sources.alerts import alerts, write_csv
from ruleforge.sources.flatten import event_time
from ruleforge.sources.rules import load_rules
from ruleforge.streaming.stateful import Expiry, correlate_stream, detect_stream, evaluate_stream

from . import catalogue
from .catalogue import _EVENTS, _RULES, _plain, _read, _yaml

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='ruleforge-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- conditions and searches ------------------------------------------------------------------------------------
_plain("q_all_of_them", "events", "event_id", "a:\n  event_type: purchase\nb:\n  value|gt: 60\ncondition: all of them", "event_type = 'purchase' AND value > 60")
_plain("q_of_a_name", "events", "event_id", "a:\n  event_type: purchase\nb:\n  value|gt: 60\ncondition: 1 of a and all of b", "event_type = 'purchase' AND value > 60")
_plain("q_nested_parentheses", "events", "event_id", "a:\n  event_type: purchase\nb:\n  value|gt: 60\nc:\n  user_id|lt: 100\ncondition: not (a and (b or not (c and not b))) or ((a))", "NOT (event_type = 'purchase' AND (value > 60 OR NOT (user_id < 100 AND NOT value > 60))) OR event_type = 'purchase'")
_plain("q_empty_search", "events", "event_id", "a: {}\nb:\n  event_type: error\ncondition: a and b", "event_type = 'error'")
_plain("q_slice_flatten", "events", "event_id", "s:\n  tags: [purchase, u9]\ncondition: s", "event_type = 'purchase' OR user_id = 9", lambda df: df.withColumn("nest", F.struct(F.array(F.struct(F.array(F.lit("x"), F.col("event_type")).alias("tags")), F.struct(F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tags"))).alias("items"))), configs=[parse_config("fieldmappings:\n  tags: $.nest.items[*].tags[*]\n")])
_plain("q_escape", "events", "event_id", f"s:\n  code|cased: '{escape_value('click*1?')}'\ncondition: s", "event_type = 'click' AND user_id % 3 = 1", lambda df: df.withColumn("code", F.concat("event_type", F.lit("*"), (F.col("user_id") % 3).cast("string"), F.lit("?"))))
_plain("q_utf16be", "events", "event_id", "s:\n  packed|cased|utf16be|base64: error\ncondition: s", "event_type = 'error'", lambda df: df.withColumn("packed", base64_text(F.encode("event_type", "UTF-16BE"))))
_plain("q_utf16_mark", "events", "event_id", "s:\n  packed|cased|utf16|base64: error\ncondition: s", "event_type = 'error'", lambda df: df.withColumn("packed", base64_text(F.concat(F.lit(b"\xff\xfe"), F.encode("event_type", "UTF-16LE")))))
_plain("q_fieldref_modified", "events", "event_id", "s:\n  packed|cased|fieldref|wide|base64: event_type\nt:\n  packed|cased|contains|fieldref|base64offset: event_type\ncondition: s or t", "event_id % 3 <> 2", lambda df: df.withColumn("packed", F.when(F.col("event_id") % 3 == 0, base64_text(F.encode("event_type", "UTF-16LE"))).when(F.col("event_id") % 3 == 1, base64_text(F.concat(F.lit(b"ab"), F.encode("event_type", "UTF-8"), F.lit(b"cd")))).otherwise("none")))
_plain("q_regex_prefilter", "documents", "doc_id", "s:\n  text|re: 'tion(able|s)? the [a-z]+'\ncondition: s", "regexp_matches(text, 'tion(able|s)? the [a-z]+')")
_plain("q_cidr6_mixed", "events", "event_id", "s:\n  ip|cidr: ['2001:db8:0:40::/58', '::1/128']\ncondition: s", "(user_id % 4 = 0 AND event_id % 256 BETWEEN 64 AND 127) OR user_id % 4 = 2", lambda df: df.withColumn("ip", F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("2001:DB8:0:"), F.hex(F.col("event_id") % 256), F.lit("::10.0.0.1"))).when(F.col("user_id") % 4 == 1, F.lit("1::2::3")).when(F.col("user_id") % 4 == 2, F.lit("0:0:0:0:0:0:0:1")).otherwise("::ffff:0.0.0.1")))


def q_lazy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy evaluation gives the results of the searches that the conditions name."""
    rule = parse_rule(_yaml("a:\n  event_type: error\nb:\n  value|gt: 100\ncondition: not a"))
    out = evaluate(_read(spark, sf_dir, "events"), rule, replace(_EVENTS, lazy=True))
    return out.select("event_id", "match", F.array_join(F.map_keys("search_results"), ",").alias("searches"))


ORACLES["q_lazy_results"] = "SELECT event_id, event_type <> 'error' AS match, 'a' AS searches FROM events"

_NEEDLES = [a + b + c for a in "aehnorst" for b in "aeinrt" for c in "dehn"]


def q_many_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of rules that look for a text each: one automaton finds all of them in a pass."""
    rules = [parse_rule(_yaml(f"s:\n  text|contains: {n}\ncondition: s", n)) for n in _NEEDLES]
    found = Bundle(rules).detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").cast("bigint").alias("ids"))


ORACLES["q_many_needles"] = f"SELECT rule_id, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents, (SELECT unnest({_NEEDLES}) AS rule_id) AS x WHERE contains(lower(text), rule_id) GROUP BY rule_id"


def q_logsource_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of several logsources, of which one is enough; a rewrite leads on to the second."""
    config = parse_config("logsourcemerging: or\nlogsources:\n  a:\n    product: shop\n    index: logs\n    conditions:\n      value|gt: 150\n    rewrite:\n      product: store\n  b:\n    product: store\n    index: more\n    conditions:\n      user_id|lt: 50\n")
    rule = parse_rule("title: shop\nlogsource:\n  product: shop\ndetection:\n  s:\n    event_type: click\n  condition: s\n")
    df = _read(spark, sf_dir, "events").withColumn("index", F.expr("element_at(array('logs', 'more', 'none'), CAST(event_id % 3 AS INT) + 1)"))
    options = replace(_EVENTS, configs=[config])
    return df.where(match_column(df, rule, options) & relevant(df, rule, F.col("index"), options)).select("event_id")


ORACLES["q_logsource_merge"] = "SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 3 < 2 AND (value > 150 OR user_id < 50)"

# -- own functions ----------------------------------------------------------------------------------------------


def _whole_history(df: DataFrame, agg: object, window: int, groups: list[str]) -> DataFrame:
    """An own aggregator: over the whole of a group, whatever the window."""
    whole, arg = Window.partitionBy(*groups), F.when(F.col("_hit"), F.col("_arg"))
    if agg.func == "count":
        return df.withColumn("_value", (F.size(F.collect_set(arg).over(whole)) if agg.field else F.count(arg).over(whole)).cast("double"))
    return df.withColumn("_value", {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg.func](arg).over(whole))


def _own(name: str, func: str, call: str, sql: str, test: str) -> None:
    rule = parse_rule(_yaml(f"s:\n  event_type: [purchase, error]\ntimeframe: 1h\ncondition: s | {call} by user_id {test}", name))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Bundle([rule], replace(_EVENTS, aggregators={func: _whole_history})).detect(_read(spark, sf_dir, "events")).select("event_id")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT e.event_id FROM events AS e JOIN (SELECT user_id, {sql} AS v FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id) AS g USING (user_id) WHERE event_type IN ('purchase', 'error') AND v {test}"


_own("q_own_count", "count", "count()", "count(*)", "> 5")
_own("q_own_distinct", "distinct", "count(event_type)", "count(DISTINCT event_type)", ">= 2")
_own("q_own_sum", "sum", "sum(value)", "sum(value)", "> 700")
_own("q_own_avg", "avg", "avg(value)", "avg(value)", "> 120")
_own("q_own_min", "min", "min(value)", "min(value)", "< 3")
_own("q_own_max", "max", "max(value)", "max(value)", "> 400")


def q_own_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered comparator and a registered part of a time."""
    register_comparator("soundslike", lambda v, text, mode: F.soundex(v.text) == F.soundex(F.lit(text)))
    register_event_modifier("second", F.second)
    df = _read(spark, sf_dir, "events")
    rule = parse_rule(_yaml("s:\n  event_type|soundslike: sygnop\n  ts|second|lt: 30\ncondition: s"))
    return df.where(match_column(df, rule)).select("event_id")


ORACLES["q_own_modifiers"] = "SELECT event_id FROM events WHERE event_type = 'signup' AND extract(second FROM ts) < 30"


def q_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that a mapped field resolves to."""
    df = _read(spark, sf_dir, "events")
    fields = Options(configs=[parse_config("fieldmappings:\n  who: [user_id, event_type]\n")]).compiler(df).fields
    return df.select("event_id", *[v.text.alias(f"v{i}") for i, (v, _) in enumerate(fields.values("who"))])


ORACLES["q_field_values"] = "SELECT event_id, CAST(user_id AS VARCHAR) AS v0, event_type AS v1 FROM events"

# -- sources and sinks ------------------------------------------------------------------------------------------


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("event_id") % 2 == 1, 0.5).otherwise(0.0)
    return _read(spark, sf_dir, "events").select(
        (F.unix_seconds(F.col("ts").cast("timestamp")) + half).alias("TimeCreated"), F.lit("host-1").alias("Computer"), F.lit("Security").alias("Channel"), F.col("user_id").alias("EventID"),
        F.col("event_id").alias("EventRecordID"), F.concat(F.lit("="), "event_type").alias("Kind"), F.lit("a.json").alias("source_file"),
    )


_LOUD = "title: loud\nid: 11111111-2222-3333-4444-555555555555\nlevel: high\ntags: [one, two]\ndetection:\n  s:\n    Kind|endswith: error\n    EventID|lt: 60\n  condition: s\n"
_LOUD_SQL = """
SELECT strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 1 THEN '.5' ELSE '' END || 'Z' AS "timestamp", 'a.json' AS source_file, CAST(event_id AS VARCHAR) AS record_id, 'host-1' AS computer, 'Security' AS channel,
  CAST(user_id AS VARCHAR) AS event_id, '11111111-2222-3333-4444-555555555555' AS rule_id, 'loud' AS rule_title, 'high' AS rule_level, 'one;two' AS rule_tags,
  '{"Channel":"Security","Computer":"host-1","EventID":' || user_id || ',"EventRecordID":' || event_id || ',"Kind":"=' || event_type || '"}' AS event_json FROM events WHERE event_type = 'error' AND user_id < 60"""


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows: time as text, record, rule, and the event as JSON."""
    rules = [parse_rule(_LOUD)]
    return alerts(Bundle(rules).detect(_logged(spark, sf_dir)), rules, ignore=("TimeCreated",))


def q_alert_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows with a cell like a formula, written as CSV and read again."""
    rules, path = [parse_rule(_LOUD)], _folder(spark, "alerts")
    rows = alerts(Bundle(rules).detect(_logged(spark, sf_dir)), rules, ignore=("TimeCreated",)).withColumn("rule_tags", F.concat(F.lit("=1+"), "record_id"))
    write_csv(rows, path)
    return spark.read.option("header", "true").option("escape", '"').schema(rows.schema).csv(path)


ORACLES["q_alerts"] = _LOUD_SQL
ORACLES["q_alert_csv"] = f"SELECT * REPLACE (chr(39) || '=1+' || record_id AS rule_tags) FROM ({_LOUD_SQL}) AS a"


def q_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of an event: a number of seconds, nothing else."""
    df = _logged(spark, sf_dir)
    return df.select("EventRecordID", F.unix_millis(event_time(df)).alias("ms"), event_time(df.withColumn("TimeCreated", F.col("TimeCreated").cast("string"))).isNull().alias("text_is_none"))


ORACLES["q_event_time"] = 'SELECT event_id AS "EventRecordID", CAST(epoch(date_trunc(\'second\', ts)) AS BIGINT) * 1000 + CASE WHEN event_id % 2 = 1 THEN 500 ELSE 0 END AS ms, true AS text_is_none FROM events'


def q_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a folder: several in a file, files of other kinds, and one that doesn't parse."""
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "below").mkdir()
        (Path(folder) / "a.yml").write_text("".join(_yaml(f"s:\n  event_type: {t}\ncondition: s", t) + "\n---\n" for t in ("click", "error")), encoding="utf-8")
        (Path(folder) / "below" / "b.YAML").write_text(_yaml("s:\n  value|gt: 150\ncondition: s", "large"), encoding="utf-8")
        (Path(folder) / "config.yml").write_text("title: c\nlogsources:\n  a:\n    product: x\n", encoding="utf-8")
        (Path(folder) / "broken.yml").write_text("detection: [", encoding="utf-8")
        (Path(folder) / "read.me").write_text("title: no rule", encoding="utf-8")
        rules = load_rules(folder)
    return Bundle(rules, _EVENTS).detect(_read(spark, sf_dir, "events")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


ORACLES["q_rule_files"] = "SELECT event_type AS rule_id, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type UNION ALL SELECT 'large', count(*) FROM events WHERE value > 150"


def q_marshalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules written as YAML and read again find what they did."""
    rules = [parse_rule(marshal_rule(r)) for r in catalogue._bundle_rules()]
    return Bundle(rules, _EVENTS).detect(_read(spark, sf_dir, "events")).select("event_id", "rule_id")


ORACLES["q_marshalled"] = ORACLES["q_bundle"]

# -- correlations -----------------------------------------------------------------------------------------------


def q_corr_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many events of one time, in the order of their numbers; a condition of two bounds."""
    rules = [parse_rule(d) for d in split_documents(_RULES + "title: ties\nname: ties\ncorrelation:\n  type: event_count\n  rules: [error, click]\n  group-by: user_id\n  timespan: 2d\n  condition:\n    gt: 1\n    lte: 2\n")]
    df = _read(spark, sf_dir, "events").withColumn("ts", F.date_trunc("week", "ts"))
    return correlate(df, rules[-1], rules, _EVENTS).select("event_id", F.col("group_values")["user_id"].alias("user_id"))


ORACLES["q_corr_ties"] = catalogue._fold_sql("event_type IN ('error', 'click')", "len(f.now) > 1 AND len(f.now) <= 2", 48).replace("epoch_us(ts)", "epoch_us(CAST(date_trunc('week', ts) AS TIMESTAMP))").replace("ORDER BY ts, event_id", "ORDER BY date_trunc('week', ts), event_id")


def q_corr_of_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlation over a rule with a windowed aggregate."""
    rules = [parse_rule(d) for d in split_documents(_RULES + "title: often\nname: often\ndetection:\n  s:\n    event_type: error\n  timeframe: 1d\n  condition: s | min(value) by user_id < 20\n---\ntitle: c\nname: c\ncorrelation:\n  type: event_count\n  rules: often\n  group-by: user_id\n  timespan: 3d\n  condition:\n    eq: 2\n")]
    return correlate(_read(spark, sf_dir, "events"), rules[-1], rules, _EVENTS).select("event_id", F.col("group_values")["user_id"].alias("user_id"))


ORACLES["q_corr_of_aggregate"] = catalogue._fold_sql(f"event_id IN ({catalogue._ranged('min(value)', 'event_type = ' + chr(39) + 'error' + chr(39), 24, '< 20')})", "len(f.now) = 2", 72)

# -- streams ----------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a plan over the stream of events gives until the input ends."""
    path, folder = f"{sf_dir}/events.parque[t]", _folder(spark, "stream")  # a pattern, as a stream takes no single file
    found = plan(spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(path))
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def _on_stream(name: str, of: str, detection: str) -> None:
    """A rule with state on a stream; of: the query that it equals."""
    rule = parse_rule(_yaml(detection, of))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _streamed(spark, sf_dir, lambda df: evaluate_stream(df, rule, _EVENTS, Expiry(watermark="1 minute")).select("event_id", "rule_id"))

    QUERIES[name] = run
    ORACLES[name] = ORACLES[of]


_on_stream("q_stream_count", "q_count_est", "s:\n  event_type: error\ntimeframe: 1d\ncondition: s | count() by user_id > 2")
_on_stream("q_stream_distinct", "q_count_distinct", "s:\n  value|gte: 0\ntimeframe: 6h\ncondition: s | count(event_type) by user_id >= 4")
_on_stream("q_stream_max", "q_max", "s:\n  event_type: purchase\ntimeframe: 1d\ncondition: s | max(value) by user_id > 300")
_on_stream("q_stream_near", "q_near", "error:\n  event_type: error\nsignup:\n  event_type: signup\ntimeframe: 5m\ncondition: error | near signup")


def q_stream_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of rules without state on a stream."""
    return _streamed(spark, sf_dir, lambda df: detect_stream(df, catalogue._bundle_rules(), _EVENTS).select("event_id", "rule_id"))


def q_stream_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlation over a correlation on a stream."""
    rules = [parse_rule(d) for d in split_documents(_RULES + catalogue._CHAIN)]
    return _streamed(spark, sf_dir, lambda df: correlate_stream(df, rules[-1], rules, _EVENTS, Expiry(watermark="1 minute")).select("event_id", F.col("group_values")["user_id"].alias("user_id")))


ORACLES["q_stream_bundle"] = ORACLES["q_bundle"]
ORACLES["q_stream_correlation"] = ORACLES["q_corr_chained"]

for _f in (q_lazy_results, q_many_needles, q_logsource_merge, q_own_modifiers, q_field_values, q_alerts, q_alert_csv, q_event_time, q_rule_files, q_marshalled, q_corr_ties, q_corr_of_aggregate, q_stream_bundle, q_stream_correlation):
    QUERIES[_f.__name__] = _f
