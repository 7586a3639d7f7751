"""The registered queries: each a rule in YAML run by the engine, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleforge.functions.gotext import base64_text
from ruleforge.operators.correlate import correlate
from ruleforge.operators.detect import Bundle, evaluate, match_column
from ruleforge.operators.options import Options
from ruleforge.operators.route import in_channel, relevant
from ruleforge.rules.reader import parse_config, parse_rule, split_documents
from ruleforge.sources.alerts import guard_cell
from ruleforge.sources.flatten import flatten_events
from ruleforge.sources.rules import exclude_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_EVENTS = Options(time="ts", seq="event_id")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _yaml(detection: str, title: str = "q") -> str:
    return f"title: {title}\ndetection:\n" + "\n".join("  " + line for line in detection.strip("\n").splitlines())


def _plain(name: str, table: str, keys: str, detection: str, where: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **options) -> None:
    """A rule without state: the keys of the events it matches. where: DuckDB predicate."""
    rule, columns = parse_rule(_yaml(detection, name)), keys.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table)
        df = prepare(df) if prepare else df
        return df.where(match_column(df, rule, Options(**options))).select(*columns)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"


def _stateful(name: str, detection: str, oracle: str, **options) -> None:
    """A rule with state over events: the ids of the events that fire."""
    rule = parse_rule(_yaml(detection, name))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Bundle([rule], replace(_EVENTS, **options)).detect(_read(spark, sf_dir, "events")).select("event_id", "rule_id")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT event_id, '{name}' AS rule_id FROM ({oracle}) AS fired"


def _correlated(name: str, documents: str, oracle: str) -> None:
    """A correlation over events, the last of the documents: the ids of the events on which it fires, and the group."""
    rules = [parse_rule(d) for d in split_documents(documents)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = correlate(_read(spark, sf_dir, "events"), rules[-1], rules, _EVENTS)
        return found.select("event_id", F.col("group_values")["user_id"].alias("user_id"))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# -- comparators ------------------------------------------------------------------------------------------------
_plain("q_eq_ci", "events", "event_id", "s:\n  event_type: ERROR\ncondition: s", "lower(event_type) = 'error'")
_plain("q_eq_cased", "orders", "o_orderkey", "s:\n  o_orderpriority|cased: 1-URGENT\ncondition: s", "o_orderpriority = '1-URGENT'")
_plain("q_wild", "part", "p_partkey", "s:\n  p_name: '*a?e*'\ncondition: s", "regexp_matches(p_name, '^.*a.e.*$', 'is')")
_plain("q_wild_cased", "customer", "c_custkey", "s:\n  c_name|cased: 'Cust*#*1?'\ncondition: s", "regexp_matches(c_name, '^Cust.*#.*1.$', 's')")
_plain("q_contains_any", "documents", "doc_id", "s:\n  text|contains: [the, license]\ncondition: s", "contains(lower(text), 'the') OR contains(lower(text), 'license')")
_plain("q_contains_all", "documents", "doc_id", "s:\n  text|contains|all: [the, license]\ncondition: s", "contains(lower(text), 'the') AND contains(lower(text), 'license')")
_plain("q_contains_wild", "documents", "doc_id", "s:\n  text|contains: 'th?n*ing'\ncondition: s", "regexp_matches(text, 'th.n.*ing', 'is')")
_plain("q_contains_cased", "documents", "doc_id", "s:\n  text|contains|cased: The\ncondition: s", "contains(text, 'The')")
_plain("q_startswith", "pages", "page_id url", "s:\n  url|startswith: HTTPS://\ncondition: s", "starts_with(lower(url), 'https://')")
_plain("q_endswith", "pages", "page_id url", "s:\n  url|endswith: ['#top', '.HTML']\ncondition: s", "lower(url) LIKE '%#top' OR lower(url) LIKE '%.html'")
_plain("q_affix_wild", "pages", "page_id", "s:\n  url|startswith: 'http*m.'\n  url|endswith: '/?*?'\ncondition: s", "regexp_matches(url, '^http.*m[.]', 'is') AND regexp_matches(url, '/..*.$', 'is')")
_plain("q_re", "pages", "page_id url", "s:\n  url|re: '/(en|es)/[0-9]+$'\ncondition: s", "regexp_matches(url, '/(en|es)/[0-9]+$')")
_plain("q_re_flags", "pages", "page_id", "s:\n  html|re|i|s: '<NAV>.*<footer>.*blog'\ncondition: s", "regexp_matches(html, '<nav>.*<footer>.*blog', 'is')")
_plain("q_re_multiline", "documents", "doc_id", "s:\n  text|re|m: '^The .*[.]$'\ncondition: s", r"len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^The .*[.]$'))) > 0")
_plain("q_num_range", "events", "event_id", "s:\n  value|gte: 100\n  value|lt: 200\ncondition: s", "value >= 100 AND value < 200")
_plain("q_num_text", "events", "event_id", "s:\n  shown|gt: 99.5\n  shown|lte: 0x100\ncondition: s", "value > 99.5 AND value <= 256", lambda df: df.withColumn("shown", F.col("value").cast("string")))
_plain("q_cidr", "events", "event_id", "s:\n  ip|cidr: [10.0.3.0/24, 10.0.64.0/18]\ncondition: s", "(user_id // 256 % 256 = 0 AND 3 = 0) OR (user_id % 256 BETWEEN 3 AND 3) OR (user_id % 256 BETWEEN 64 AND 127)", lambda df: df.withColumn("ip", F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"))))
_plain("q_cidr6", "events", "event_id", "s:\n  ip|cidr: 'fd00::/120'\ncondition: s", "user_id % 512 < 256", lambda df: df.withColumn("ip", F.concat(F.lit("fd00::"), F.lower(F.hex(F.col("user_id") % 512)))))
_plain("q_lineitem_bundle", "lineitem", "l_orderkey l_linenumber", "a:\n  l_returnflag: R\n  l_quantity|gte: 40\nb:\n  l_linestatus: o\n  l_discount|lt: 0.02\ncondition: a or b", "(l_returnflag = 'R' AND l_quantity >= 40) OR (l_linestatus = 'O' AND l_discount < 0.02)")
# -- dates ------------------------------------------------------------------------------------------------------
_plain("q_hour", "events", "event_id", "s:\n  ts|hour|gte: 9\n  ts|hour|lt: 17\ncondition: s", "extract(hour FROM ts) BETWEEN 9 AND 16")
_plain("q_week", "events", "event_id", "s:\n  ts|week: 2\ncondition: s", "extract(week FROM ts) = 2")
_plain("q_month_day", "orders", "o_orderkey", "s:\n  o_orderdate|month: [2, 11]\n  o_orderdate|day|gt: 25\n  o_orderdate|year|neq: 1995\ncondition: s", "extract(month FROM o_orderdate) IN (2, 11) AND extract(day FROM o_orderdate) > 25 AND extract(year FROM o_orderdate) <> 1995")
_plain("q_minute_offset", "events", "event_id", "s:\n  stamp|hour: 23\n  stamp|minute|lt: 30\ncondition: s", "extract(hour FROM ts) = 23 AND extract(minute FROM ts) < 30", lambda df: df.withColumn("stamp", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))))
# -- nulls, presence, negation ----------------------------------------------------------------------------------
_LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents AS d LEFT JOIN labels AS l USING (doc_id))"


def _with_labels(name: str, detection: str, where: str) -> None:
    rule = parse_rule(_yaml(detection, name))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, "documents").select("doc_id", "lang").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
        return df.where(match_column(df, rule)).select("doc_id")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id FROM {_LABELLED} AS d WHERE {where}"


_with_labels("q_null", "s:\n  quality: null\ncondition: s", "quality IS NULL")
_with_labels("q_neq", "s:\n  quality|neq: 1\ncondition: s", "coalesce(quality <> 1, true)")
_with_labels("q_exists", "s:\n  toxic|exists: true\n  lang: de\ncondition: s", "toxic IS NOT NULL AND lang = 'de'")
_with_labels("q_not_null_logic", "s:\n  toxic|gte: 1\ncondition: not s", "NOT coalesce(toxic >= 1, false)")
_plain("q_fieldref", "lineitem", "l_orderkey l_linenumber", "s:\n  l_suppkey|fieldref: l_partkey\nt:\n  l_quantity|gt|fieldref: l_suppkey\ncondition: s or t", "l_suppkey = l_partkey OR l_quantity > l_suppkey")
_plain("q_fieldref_text", "pages", "page_id", "s:\n  url|contains|fieldref: code\ncondition: s", "contains(lower(url), CAST(page_id % 100 AS VARCHAR))", lambda df: df.withColumn("code", (F.col("page_id") % 100).cast("string")))
# -- keywords ---------------------------------------------------------------------------------------------------
_plain("q_keywords", "conversations", "conv_id turn", "s: [assistant, error]\ncondition: s", "contains(lower(role), 'assistant') OR contains(lower(text), 'assistant') OR contains(lower(role), 'error') OR contains(lower(text), 'error')")
_plain("q_keyword_wild", "conversations", "conv_id turn", "s: ['th?t*on']\ncondition: s", "regexp_matches(role, 'th.t.*on', 'i') OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, 'th.t.*on', 'i'))) > 0")
_plain("q_keywords_cased", "conversations", "conv_id turn", "s: ['The']\ncondition: s", "contains(role, 'The') OR contains(text, 'The')", case_sensitive=True)
# -- boolean algebra --------------------------------------------------------------------------------------------
_plain("q_or_of_maps", "events", "event_id", "s:\n  - event_type: error\n    value|gt: 50\n  - event_type: signup\n    user_id|lt: 20\ncondition: s", "(event_type = 'error' AND value > 50) OR (event_type = 'signup' AND user_id < 20)")
_plain("q_not_filter", "events", "event_id", "s:\n  event_type: [click, view]\nf:\n  value|lt: 30\ncondition: s and not f", "event_type IN ('click', 'view') AND NOT value < 30")
_plain("q_1_of_them", "events", "event_id", "a:\n  event_type: error\nb:\n  value|gt: 190\ncondition: 1 of them", "event_type = 'error' OR value > 190")
_plain("q_all_of_pattern", "events", "event_id", "sel_a:\n  event_type: purchase\nsel_b:\n  value|gt: 60\nother:\n  user_id: 1\ncondition: all of sel_* and not 1 of oth*", "event_type = 'purchase' AND value > 60 AND user_id <> 1")
_plain("q_undefined_search", "events", "event_id", "a:\n  event_type: error\ncondition: (a or missing) and not missing", "event_type = 'error'")
_plain("q_conditions_list", "events", "event_id", "a:\n  event_type: error\nb:\n  user_id: 7\ncondition:\n  - a and b\n  - b and not a", "user_id = 7")
# -- placeholders and value modifiers ---------------------------------------------------------------------------
_plain("q_placeholder", "events", "event_id", "s:\n  user_id: '%vips%'\ncondition: s", "user_id IN (3, 5, 8, 13)", expander={"vips": [3, 5, 8, 13]})
_plain("q_expand", "pages", "page_id", "s:\n  url|contains|expand: '/%langs%/%tens%'\ncondition: s", "contains(url, '/en/1') OR contains(url, '/en/2') OR contains(url, '/fr/1') OR contains(url, '/fr/2')", expander={"langs": ["en", "fr"], "tens": [1, 2]})
_plain("q_placeholder_wide", "events", "event_id", "s:\n  user_id: '%many%'\ncondition: s", "user_id % 3 = 0 AND user_id < 300", expander={"many": list(range(0, 300, 3))})
_plain("q_windash", "events", "event_id", "s:\n  line|contains|windash: ' -click'\ncondition: s", "event_type = 'click' AND event_id % 5 < 5", lambda df: df.withColumn("line", F.concat(F.lit("run "), F.expr("element_at(array('-', '/', '–', '—', '―'), CAST(event_id % 5 AS INT) + 1)"), F.col("event_type"))))
_plain("q_base64", "documents", "doc_id", "s:\n  packed|startswith|base64: The\ncondition: s", "lower(to_base64(encode(text))) LIKE lower('VGhl') || '%'", lambda df: df.withColumn("packed", base64_text(F.encode("text", "UTF-8"))))
_plain("q_base64offset", "documents", "doc_id", "s:\n  packed|contains|cased|base64offset: ' the '\ncondition: s", "contains(to_base64(encode(text)), 'IHRoZS') OR contains(to_base64(encode(text)), 'B0aGUg') OR contains(to_base64(encode(text)), 'gdGhlI')", lambda df: df.withColumn("packed", base64_text(F.encode("text", "UTF-8"))))
_plain("q_utf16", "events", "event_id", "s:\n  packed|cased|wide|base64: error\ncondition: s", "event_type = 'error'", lambda df: df.withColumn("packed", base64_text(F.encode("event_type", "UTF-16LE"))))
# -- nested fields ----------------------------------------------------------------------------------------------
_MAPPED = parse_config("fieldmappings:\n  k: $.props.k\n  who: [user_id, event_id]\n  names: $.nest.items[*].name\n")
_plain("q_json_path", "events", "event_id", "s:\n  k|gt: 50\ncondition: s", "CAST(props->>'$.k' AS INT) > 50", configs=[_MAPPED])
_plain("q_field_mapping", "events", "event_id", "s:\n  who: [11, 12]\ncondition: s", "user_id IN (11, 12) OR event_id IN (11, 12)", configs=[_MAPPED])
_plain("q_nested_flatten", "events", "event_id", "s:\n  names: [purchase, u9]\ncondition: s", "event_type = 'purchase' OR user_id = 9", lambda df: df.withColumn("nest", F.struct(F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"))).alias("items"))), configs=[_MAPPED])
_plain("q_map_mode", "events", "event_id", "s:\n  event_type: click\n  value|gte: 150\n  missing: null\ncondition: s", "event_type = 'click' AND value >= 150", lambda df: df.select("event_id", F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string")).alias("fields")), mode="map", source="fields")
_plain("q_json_mode", "events", "event_id", "s:\n  event_type: view\n  user_id|lt: 10\n  extra|exists: false\ncondition: s", "event_type = 'view' AND user_id < 10", lambda df: df.select("event_id", F.to_json(F.struct("event_type", "user_id", "value")).alias("raw")), mode="json", source="raw")


# -- bundles and results ----------------------------------------------------------------------------------------
def _bundle_rules() -> list:
    types = ("click", "error", "purchase", "signup", "view")
    return [parse_rule(_yaml(f"s:\n  event_type: {t}\n  value|gte: {v}\nf:\n  user_id|lt: {v // 2}\ncondition: s and not f", f"{t}_{v}")) for t in types for v in (20, 60, 110, 160)]


def q_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 rules in one scan."""
    return Bundle(_bundle_rules(), _EVENTS).detect(_read(spark, sf_dir, "events")).select("event_id", "rule_id")


def q_bundle_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for every rule, matched or not."""
    return Bundle(_bundle_rules(), _EVENTS).results(_read(spark, sf_dir, "events")).groupBy("rule_id", "match").agg(F.count(F.lit(1)).alias("n"))


def q_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of each search of a rule and of each condition."""
    rule = parse_rule(_yaml("a:\n  event_type: error\nb:\n  value|gt: 100\ncondition:\n  - a and b\n  - not a"))
    out = evaluate(_read(spark, sf_dir, "events"), rule, _EVENTS)
    return out.select("event_id", "match", F.col("search_results")["a"].alias("a"), F.col("search_results")["b"].alias("b"), F.col("condition_results")[0].alias("c0"), F.col("condition_results")[1].alias("c1"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a bundle: event, rule and its title."""
    return q_bundle(spark, sf_dir)


QUERIES |= {"q_bundle": q_bundle, "q_bundle_results": q_bundle_results, "q_search_results": q_search_results}
_BUNDLE_SQL = "SELECT event_id, t || '_' || v AS rule_id, coalesce(event_type = t AND value >= v AND NOT user_id < v // 2, false) AS match FROM events, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t) AS a, (SELECT unnest([20, 60, 110, 160]) AS v) AS b"
ORACLES["q_bundle"] = f"SELECT event_id, rule_id FROM ({_BUNDLE_SQL}) AS x WHERE match"
ORACLES["q_bundle_results"] = f"SELECT rule_id, match, count(*) AS n FROM ({_BUNDLE_SQL}) AS x GROUP BY rule_id, match"
ORACLES["q_search_results"] = "SELECT event_id, (event_type = 'error' AND value > 100) OR event_type <> 'error' AS match, event_type = 'error' AS a, value > 100 AS b, event_type = 'error' AND value > 100 AS c0, event_type <> 'error' AS c1 FROM events"

# -- windowed aggregates ----------------------------------------------------------------------------------------
_S = "s:\n  event_type: {}\n"


def _estimate(func: str, where: str, group: str, window: int, test: str) -> str:
    """Two-bucket estimate in SQL; window in seconds, buckets from year 1."""
    us = "epoch_us(ts) + 62135596800000000"
    w = window * 1_000_000
    value = {"count": "prev_n * share + run_n", "sum": "prev_s * share + run_s", "avg": "(prev_s * share + run_s) / (prev_n * share + run_n)"}[func]
    return f"""
WITH e AS (SELECT *, {us} AS us, ({us}) // {w} AS b FROM events WHERE {where}),
t AS (SELECT {group}, b, count(*) AS n, sum(value) AS s FROM e GROUP BY {group}, b),
r AS (SELECT e.event_id, count(*) OVER x AS run_n, sum(e.value) OVER x AS run_s, coalesce(t.n, 0) AS prev_n, coalesce(t.s, 0) AS prev_s, ({w} - (e.us - e.b * {w})) / {w}.0::DOUBLE AS share
  FROM e LEFT JOIN t ON e.{group} = t.{group} AND e.b = t.b + 1 WINDOW x AS (PARTITION BY e.{group}, e.b ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id FROM r WHERE {value} {test}"""


def _ranged(func: str, where: str, hours: int, test: str) -> str:
    return f"SELECT event_id FROM (SELECT event_id, {func} OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW) AS v FROM events WHERE {where}) AS x WHERE v {test}"


_DAY = 86400
_stateful("q_count_est", _S.format("error") + "timeframe: 1d\ncondition: s | count() by user_id > 2", _estimate("count", "event_type = 'error'", "user_id", _DAY, "> 2"))
_stateful("q_count_week", _S.format("error") + "timeframe: 7d\ncondition: s | count() by user_id >= 9", _estimate("count", "event_type = 'error'", "user_id", 7 * _DAY, ">= 9"))
_stateful("q_count_exact", _S.format("error") + "timeframe: 1d\ncondition: s | count() by user_id > 2", _ranged("count(*)", "event_type = 'error'", 24, "> 2"), window_mode="exact")
_stateful("q_count_distinct", "s:\n  value|gte: 0\ntimeframe: 6h\ncondition: s | count(event_type) by user_id >= 4", _ranged("count(DISTINCT event_type)", "value >= 0", 6, ">= 4"))
_stateful("q_sum_est", _S.format("purchase") + "timeframe: 1d\ncondition: s | sum(value) by user_id > 250", _estimate("sum", "event_type = 'purchase'", "user_id", _DAY, "> 250"))
_stateful("q_avg_est", _S.format("purchase") + "timeframe: 1d\ncondition: s | avg(value) by user_id > 120", _estimate("avg", "event_type = 'purchase'", "user_id", _DAY, "> 120"))
_stateful("q_min", _S.format("purchase") + "timeframe: 1d\ncondition: s | min(value) by user_id < 5", _ranged("min(value)", "event_type = 'purchase'", 24, "< 5"))
_stateful("q_max", _S.format("purchase") + "timeframe: 1d\ncondition: s | max(value) by user_id > 300", _ranged("max(value)", "event_type = 'purchase'", 24, "> 300"))
_stateful("q_count_multi_key", "s:\n  event_type: [click, view]\ntimeframe: 1d\ncondition: s | count() by user_id, event_type >= 4", _ranged("count(*)", "event_type IN ('click', 'view')", 24, ">= 4").replace("PARTITION BY user_id", "PARTITION BY user_id, event_type"), window_mode="exact")
_stateful("q_mixed_conditions", "a:\n  event_type: signup\n  value|gt: 150\ns:\n  event_type: error\ntimeframe: 1d\ncondition:\n  - a\n  - s | count() by user_id > 2", "SELECT event_id FROM events WHERE event_type = 'signup' AND value > 150 UNION ALL " + _ranged("count(*)", "event_type = 'error'", 24, "> 2"), window_mode="exact")
# -- near -------------------------------------------------------------------------------------------------------
_NEAR = "SELECT event_id FROM (SELECT event_id, event_type, ts, {lasts} FROM events WINDOW x AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS e WHERE {where}"
_LAST = "last_value(CASE WHEN {} THEN ts END IGNORE NULLS) OVER x AS {}"
_stateful("q_near", "error:\n  event_type: error\nsignup:\n  event_type: signup\ntimeframe: 5m\ncondition: error | near signup", _NEAR.format(lasts=_LAST.format("event_type = 'signup'", "a"), where="event_type = 'error' AND a >= ts - INTERVAL 5 MINUTE"))
_stateful("q_near_and", "error:\n  event_type: error\nsignup:\n  event_type: signup\nbig:\n  value|gt: 100\ntimeframe: 10m\ncondition: error | near signup and not big", _NEAR.format(lasts=_LAST.format("event_type = 'signup'", "a") + ", " + _LAST.format("value > 100", "b"), where="event_type = 'error' AND a >= ts - INTERVAL 10 MINUTE AND NOT coalesce(b >= ts - INTERVAL 10 MINUTE, false)"))
_stateful("q_near_any_time", "error:\n  event_type: error\nrare:\n  event_type: signup\n  user_id: 5\ncondition: error | near rare", _NEAR.format(lasts=_LAST.format("event_type = 'signup' AND user_id = 5", "a"), where="event_type = 'error' AND a IS NOT NULL"))
# -- correlations -----------------------------------------------------------------------------------------------
_RULES = "".join(f"title: {t}\nname: {t}\ndetection:\n  s:\n    event_type: {t}\n  condition: s\n---\n" for t in ("click", "error", "purchase", "signup", "view"))


def _fold_sql(where: str, fires: str, hours: int) -> str:
    """A fold with reset as a recursive query: the state is a list of (us, what), one row per event and user."""
    w = hours * 3_600_000_000
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {where}),
f AS (SELECT event_id, user_id, n, [{{'us': us, 'what': what}}] AS now FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.n, list_append(list_filter(CASE WHEN {fires} THEN [] ELSE f.now END, lambda x: x.us >= e.us - {w}), {{'us': e.us, 'what': e.what}})
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM f WHERE {fires}"""


_correlated("q_corr_event_count", _RULES + "title: burst\nname: burst\ncorrelation:\n  type: event_count\n  rules: error\n  group-by: user_id\n  timespan: 1d\n  condition:\n    gte: 3\n", _fold_sql("event_type = 'error'", "len(f.now) >= 3", 24))
_correlated("q_corr_value_count", _RULES + "title: many\nname: many\ncorrelation:\n  type: value_count\n  rules: [click, error, purchase, signup, view]\n  group-by: [user_id]\n  timespan: 6h\n  condition:\n    gte: 4\n    field: event_type\n", _fold_sql("true", "len(list_distinct(list_transform(f.now, lambda x: x.what))) >= 4", 6))
_correlated("q_corr_temporal", _RULES + "title: both\nname: both\ncorrelation:\n  type: temporal\n  rules: [error, signup]\n  group-by: [user_id]\n  timespan: 6h\n", _fold_sql("event_type IN ('error', 'signup')", "len(list_distinct(list_transform(f.now, lambda x: x.what))) = 2", 6))
_ORDERED = "len(list_filter(f.now, lambda a: a.what = 'signup' AND len(list_filter(f.now, lambda b: b.what = 'error' AND list_position(f.now, b) > list_position(f.now, a) AND len(list_filter(f.now, lambda c: c.what = 'purchase' AND list_position(f.now, c) > list_position(f.now, b))) > 0)) > 0)) > 0"
_correlated("q_corr_ordered", _RULES + "title: order\nname: order\ncorrelation:\n  type: temporal_ordered\n  rules: [signup, error, purchase]\n  group-by: [user_id]\n  timespan: 1d\n", _fold_sql("event_type IN ('signup', 'error', 'purchase')", _ORDERED, 24))
_CHAIN = "title: burst\nname: burst\ncorrelation:\n  type: event_count\n  rules: error\n  group-by: user_id\n  timespan: 1d\n  condition:\n    gte: 3\n---\ntitle: chain\nname: chain\ncorrelation:\n  type: temporal_ordered\n  rules: [burst, purchase]\n  group-by: user_id\n  timespan: 1d\n"
_correlated("q_corr_chained", _RULES + _CHAIN, f"""
WITH RECURSIVE fired AS ({_fold_sql("event_type = 'error'", "len(f.now) >= 3", 24)}),
e2 AS (SELECT event_id, user_id, us, what, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM (
  SELECT e.event_id, e.user_id, epoch_us(e.ts) AS us, 'burst' AS what FROM events AS e JOIN fired USING (event_id) UNION ALL
  SELECT event_id, user_id, epoch_us(ts), 'purchase' FROM events WHERE event_type = 'purchase') AS u),
g AS (SELECT event_id, user_id, n, [{{'us': us, 'what': what}}] AS now FROM e2 WHERE n = 1
  UNION ALL
  SELECT e2.event_id, e2.user_id, e2.n, list_append(list_filter(CASE WHEN {{test}} THEN [] ELSE g.now END, lambda x: x.us >= e2.us - 86400000000), {{'us': e2.us, 'what': e2.what}})
  FROM g JOIN e2 ON e2.user_id = g.user_id AND e2.n = g.n + 1)
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM g WHERE {{test}}""".replace("{test}", "(len(g.now) > 1 AND g.now[-1].what = 'purchase' AND list_contains(list_transform(g.now, lambda x: x.what), 'burst'))"))
_correlated("q_corr_alias", _RULES + "title: alias\nname: alias\ncorrelation:\n  type: temporal\n  rules: [error, signup]\n  group-by: [user_id]\n  timespan: 6h\n  aliases:\n    user_id:\n      error: user_id\n      signup: user_id\n", ORACLES["q_corr_temporal"])

# -- routing, exclusion, output ---------------------------------------------------------------------------------
_ROUTED = parse_config("logsources:\n  web:\n    product: shop\n    index: 'logs-*'\n    conditions:\n      value|gt: 20\n")
_SHOP = parse_rule("title: shop\nlogsource:\n  product: shop\n  service: sysmon\ndetection:\n  s:\n    event_type: click\n  condition: s\n")


def q_route_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on the indexes and under the conditions that the configuration gives it."""
    df = _read(spark, sf_dir, "events").withColumn("index", F.concat(F.lit("logs-"), (F.col("user_id") % 3).cast("string"))).withColumn("index", F.when(F.col("user_id") % 3 == 0, F.lit("metrics")).otherwise(F.col("index")))
    options = replace(_EVENTS, configs=[_ROUTED])
    return df.where(match_column(df, _SHOP, options) & relevant(df, _SHOP, F.col("index"), options)).select("event_id", "index")


def q_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for one channel, over events of several."""
    df = _read(spark, sf_dir, "events").withColumn("Channel", F.expr("element_at(array('MICROSOFT-Windows-Sysmon/Operational', 'Security', '', NULL), CAST(user_id % 4 AS INT) + 1)"))
    return df.where(match_column(df, _SHOP) & in_channel(_SHOP, F.col("Channel"))).select("event_id")


def q_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle without the rules on an exclusion list."""
    rules = [replace(r, id=f"00000000-0000-0000-0000-{i:012d}") for i, r in enumerate(_bundle_rules())]
    kept = exclude_rules(rules, "00000000-0000-0000-0000-000000000003 # noisy\n# a remark\n00000000-0000-0000-0000-000000000007\n")
    return Bundle(kept, _EVENTS).detect(_read(spark, sf_dir, "events")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def q_csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a spreadsheet could take for formulas."""
    df = _read(spark, sf_dir, "events").select("event_id", F.concat(F.expr("element_at(array('=', '+', '-', '@', 'x', ' ='), CAST(event_id % 6 AS INT) + 1)"), F.col("event_type")).alias("cell"))
    return df.select("event_id", guard_cell(F.col("cell")).alias("cell"))


def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested log records as flat events."""
    df = _read(spark, sf_dir, "events")
    system = F.struct(F.struct(F.lit("shop").alias("Name")).alias("Provider"), F.struct((F.col("user_id") % 7).cast("int").alias("Value")).alias("EventID"), F.lit("Security").alias("Channel"), F.col("event_id").alias("EventRecordID"))
    data = F.struct(F.concat(F.lit("  "), F.col("event_type"), F.lit("\t\n")).alias("Kind"), F.struct(F.col("value").alias("Amount")).alias("Inner"), F.lit("data").alias("Channel"))
    return flatten_events(df.select(F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event")).alias("raw")), "raw").select("EventRecordID", "EventID", "Provider_Name", "Channel", "Kind", "Amount")


QUERIES |= {"q_route_index": q_route_index, "q_channel": q_channel, "q_exclude": q_exclude, "q_csv_guard": q_csv_guard, "q_flatten": q_flatten}
ORACLES["q_route_index"] = "SELECT event_id, 'logs-' || (user_id % 3) AS \"index\" FROM events WHERE event_type = 'click' AND value > 20 AND user_id % 3 <> 0"
ORACLES["q_channel"] = "SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 4 <> 1"
ORACLES["q_exclude"] = f"SELECT i AS rule_id, count(*) AS n FROM (SELECT '00000000-0000-0000-0000-' || lpad(CAST((list_position(['click', 'error', 'purchase', 'signup', 'view'], split_part(rule_id, '_', 1)) - 1) * 4 + list_position(['20', '60', '110', '160'], split_part(rule_id, '_', 2)) - 1 AS VARCHAR), 12, '0') AS i FROM ({_BUNDLE_SQL}) AS x WHERE match) AS y WHERE right(i, 2) NOT IN ('03', '07') GROUP BY i"
ORACLES["q_csv_guard"] = "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN '''' ELSE '' END || ['=', '+', '-', '@', 'x', ' ='][event_id % 6 + 1] || event_type AS cell FROM events"
ORACLES["q_flatten"] = "SELECT event_id AS \"EventRecordID\", CAST(user_id % 7 AS INT) AS \"EventID\", 'shop' AS \"Provider_Name\", 'data' AS \"Channel\", event_type AS \"Kind\", value AS \"Amount\" FROM events"
