"""Bundles and single rules agree on any rules; ties, addresses, and texts found in one pass."""

import ipaddress

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleforge.functions.comparators import ip6_figures
from ruleforge.operators.correlate import correlate
from ruleforge.operators.detect import Bundle, match_column
from ruleforge.operators.options import Options
from ruleforge.rules.reader import parse_rule, split_documents
from ruleforge.streaming.stateful import detect_stream

WORDS = st.text("abAB*?", min_size=1, max_size=3)
LEAF = st.one_of(
    st.tuples(st.sampled_from(["name", "other", "gone"]), st.sampled_from(["", "|contains", "|startswith", "|endswith", "|contains|cased", "|contains|all"]), st.lists(WORDS, min_size=1, max_size=3)),
    st.tuples(st.just("n"), st.sampled_from(["|gt", "|lte", ""]), st.lists(st.integers(-2, 3), min_size=1, max_size=2)),
)
CONDITION = st.recursive(st.sampled_from(["a", "b", "c", "1 of them", "all of them", "1 of a*"]), lambda inner: st.one_of(st.tuples(inner, st.sampled_from([" and ", " or "]), inner).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), inner.map(lambda x: f"not {x}")), max_leaves=5)
RULE = st.tuples(st.lists(st.lists(LEAF, min_size=1, max_size=2, unique_by=lambda x: x[0] + x[1]), min_size=3, max_size=3), CONDITION)


def made(number, rule):
    searches, condition = rule
    text = "".join(f"  {name}:\n" + "".join(f"    {f}{m}: {list(values)!r}\n" for f, m, values in fields) for name, fields in zip("abc", searches))
    return parse_rule(f"title: r{number}\ndetection:\n{text}  condition: {condition}\n")


@pytest.fixture(scope="module")
def events(spark):
    texts = [None, "", "a", "A", "ab", "aB", "*", "b?a", "AAB", "bab", "ba*b"]
    return spark.createDataFrame([(i, texts[i % 11], texts[i % 7], i % 5 - 2 if i % 4 else None) for i in range(77)], "id int, name string, other string, n int").cache()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(RULE, min_size=3, max_size=6))
def test_bundles_find_what_single_rules_find(events, rules):
    rules = [made(i, r) for i, r in enumerate(rules)]
    wanted = {(r.key, x.id) for r in rules for x in events.where(match_column(events, r)).select("id").collect()}
    for needles in (1, 1000):
        bundle = Bundle(rules, needles=needles)
        assert {(x.rule_id, x.id) for x in bundle.detect(events).collect()} == wanted
        assert {(x.rule_id, x.id) for x in bundle.results(events).where("match").collect()} == wanted
        assert not bundle.skipped_rules


def test_bundle_reads_its_input_once(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) AS name").write.parquet(str(tmp_path / "t"))
    rules = [parse_rule(f"title: r{i}\ndetection:\n  s:\n    id|gt: {i}\n  condition: s\n") for i in range(250)]
    plan = Bundle(rules).detect(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_events_of_one_time_fire_for_themselves(spark):
    """Without numbers, events of one time are still told apart: of three that share it one fires."""
    rules = [parse_rule(d) for d in split_documents("title: any\nname: any\ndetection:\n  s:\n    kind: x\n  condition: s\n---\ntitle: c\nname: c\ncorrelation:\n  type: event_count\n  rules: any\n  timespan: 1h\n  condition:\n    gte: 3\n")]
    df = spark.createDataFrame([(f"e{i}", "x", 1_000_000) for i in range(5)], "id string, kind string, ts long")
    found = correlate(df, rules[-1], rules, Options(time="ts")).collect()
    assert len(found) == 1 and found[0].rule_id == "c" and found[0].group_values == {}


def test_ip6_figures(spark):
    given_ = ["::", "::1", "1::", "2001:DB8::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", ":1::", "1:", "12345::", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:7:8:9", "1.2.3.4", "::g", "", None, "::1.2.3", "1:2:3:4:5:6:7:", ":::"]
    found = {r.t: r.h for r in spark.createDataFrame([(t,) for t in given_], "t string").select("t", ip6_figures(F.col("t")).alias("h")).collect()}
    for t in given_:
        try:
            wanted = f"{int(ipaddress.IPv6Address(t)):032x}" if t else None
        except ValueError:
            wanted = None
        if t == "1:2:3:4:5:6:7::8":  # nothing is left out
            wanted = None
        assert found[t] == wanted, t


def test_needles_on_a_stream_need_no_other_plan(spark, tmp_path):
    rules = [parse_rule(f"title: r{i}\ndetection:\n  s:\n    name|contains: n{i}x\n  condition: s\n") for i in range(70)]
    spark.range(300).selectExpr("id", "concat('n', id, 'x') AS name").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = detect_stream(spark.readStream.schema("id bigint, name string").parquet(str(tmp_path / "in")), rules).writeStream.format("memory").queryName("needles").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.id for r in spark.table("needles").collect()) == list(range(70))
