"""Windows, near and correlations: timings of invented scenarios, and plans against folds fed event by event."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ruleforge.operators.correlate import CorrelationError, correlate, resolve
from ruleforge.operators.detect import Bundle, evaluate
from ruleforge.operators.folds import CorrelationFold, Distinct, Extremum, LastSeen, TwoBucket, aggregate_fold
from ruleforge.operators.options import Options
from ruleforge.rules.reader import parse_rule

S, M = 1_000_000, 60_000_000
TIMED = Options(time="us", seq="seq")


def rule(detection, name="r"):
    return parse_rule(f"title: {name}\nname: {name}\ndetection:\n" + "\n".join("  " + x for x in detection.splitlines()))


def frame(spark, rows):
    """rows: (minutes, kind, user, value)."""
    return spark.createDataFrame([(int(t * M), i, k, u, v) for i, (t, k, u, v) in enumerate(rows)], "us bigint, seq bigint, kind string, user string, value double")


def fired(spark, rows, detection, **options):
    found = Bundle([rule(detection)], Options(**(TIMED.__dict__ | options))).detect(frame(spark, rows))
    return sorted(r.seq for r in found.collect())


@pytest.mark.parametrize(("step", "hits"), [(10, []), (1, [3])])
def test_count_threshold(spark, step, hits):
    rows = [(i * step, "fail", "u", None) for i in range(4)]
    text = "s:\n  kind: fail\ntimeframe: 5m\ncondition: s | count() by user > 3"
    assert fired(spark, rows, text, window_mode="exact") == hits
    if step == 10:
        assert fired(spark, rows, text) == hits


def test_groups_and_missing_fields(spark):
    rows = [(0, "fail", "a", 1.0), (1, "fail", None, 1.0), (2, "fail", None, 1.0), (3, "fail", "a", None), (4, "ok", "a", 1.0)]
    assert fired(spark, rows, "s:\n  kind: fail\ntimeframe: 1h\ncondition: s | count() by user >= 2", window_mode="exact") == [2, 3]
    assert fired(spark, rows, "s:\n  kind: fail\ntimeframe: 1h\ncondition: s | sum(value) by user >= 2", window_mode="exact") == [2]
    assert fired(spark, rows, "s:\n  kind: fail\ntimeframe: 1h\ncondition: s | count(value) >= 2", window_mode="exact") == [3]
    assert fired(spark, rows, "s:\n  kind: fail\ncondition: s | count() >= 4", window_mode="exact") == [3]


def test_results_for_every_event(spark):
    rows = [(i, "fail" if i % 2 else "ok", "u", float(i)) for i in range(8)]
    for text in ("s:\n  kind: fail\ntimeframe: 4m\ncondition: s | count() by user > 1", "s:\n  kind: fail\ntimeframe: 4m\ncondition: s | count(value) by user > 1", "s:\n  kind: fail\ntimeframe: 4m\ncondition: s | max(value) by user > 4", "s:\n  kind: fail\no:\n  kind: ok\ntimeframe: 1m\ncondition: s | near o"):
        found = evaluate(frame(spark, rows), rule(text), TIMED).collect()
        assert len(found) == 8 and any(r.match for r in found)
        assert sorted(r.seq for r in found if r.match) == fired(spark, rows, text)


@pytest.mark.parametrize("func", ["count()", "count(value)", "sum(value)", "avg(value)", "min(value)", "max(value)"])
def test_plans_equal_folds(spark, func):
    rng = random.Random(func)
    moments = sorted(rng.sample(range(3000), 200))
    rows = [(t / 7, rng.choice(["fail", "fail", "ok"]), rng.choice(["hot", "hot", "a", None]), float(rng.randrange(6))) for t in moments]
    window, threshold = 30 * M, {"count()": 8, "count(value)": 5, "sum(value)": 12, "avg(value)": 2, "min(value)": 0, "max(value)": 4}[func]
    op = "<=" if func == "min(value)" else ">="
    folds, wanted = {}, []
    for i, (t, kind, user, value) in enumerate(rows):
        if kind != "fail":
            continue
        name = "distinct" if func == "count(value)" else func.split("(")[0]
        fold = folds.setdefault(user, aggregate_fold(name, window))
        got = fold.add(int(t * M), value if name not in ("count", "distinct") else 1.0 if name == "count" else str(value))
        if (got <= threshold) if op == "<=" else (got >= threshold):
            wanted.append(i)
    assert fired(spark, rows, f"s:\n  kind: fail\ntimeframe: 30m\ncondition: s | {func} by user {op} {threshold}") == wanted
    assert 0 < len(wanted) < 150


def test_two_bucket_estimate():
    counter = TwoBucket(60 * S)
    for i in range(1, 11):
        counter.add(i * S, 1)
    assert 0 < counter.add(90 * S, 1) - 1 < 10
    assert TwoBucket(60 * S).add(5, 1) == 1
    late = TwoBucket(60 * S)
    late.add(100 * S, 1)
    assert late.add(10 * S, 1) == 2


def test_distinct_and_extrema():
    d = Distinct(5 * M)
    assert [d.add(0, "a"), d.add(M, "b"), d.add(6 * M, "c")] == [1, 2, 2]
    d = Distinct(5 * M)
    assert [d.add(0, "a"), d.add(4 * M, "a"), d.add(6 * M, "b"), d.add(10 * M, "c")] == [1, 1, 2, 2]
    e = Extremum(5 * M, 1)
    assert [e.add(t, v) for t, v in ((0, 10), (M, 3), (2 * M, 7), (int(6.5 * M), 9))] == [10, 3, 3, 7]


def test_folds_scale():
    began = time.perf_counter()
    d, e = Distinct(300 * S), Extremum(300 * S, 1)
    for i in range(200_000):
        d.add(i * 1000, str(i % 100_000))
        e.add(i * 1000, (i * 7919) % 1000)
    assert d.add(200_000_000, "0") == 100_000
    assert time.perf_counter() - began < 30


def test_near(spark):
    text = "sel:\n  kind: main\nfil:\n  kind: side\ntimeframe: 5m\ncondition: sel | near fil"
    assert fired(spark, [(0, "side", "", None), (1, "main", "", None)], text) == [1]
    assert fired(spark, [(0, "side", "", None), (5, "main", "", None), (6, "main", "", None)], text) == [1]
    assert fired(spark, [(0, "main", "", None), (1, "side", "", None)], text) == []
    assert fired(spark, [(0, "side", "", None), (900, "main", "", None)], text.replace("timeframe: 5m\n", "")) == [1]
    assert fired(spark, [(0, "main", "", None)], text.replace("near fil", "near sel")) == [0]
    fold = LastSeen(5 * M)
    assert [fold.see(t * M, m, ["x"])["x"] for t, m in ((0, ["x"]), (5, []), (6, []))] == [True, True, False]


RULES = [rule(f"s:\n  kind: {k}\ncondition: s", k) for k in ("A", "B", "C")]


def correlation(text, name="c"):
    return parse_rule(f"title: {name}\nname: {name}\ncorrelation:\n" + "\n".join("  " + x for x in text.splitlines()))


def alerts_of(spark, rows, c, rules=()):
    return sorted((r.seq, tuple(sorted(r.group_values.items()))) for r in correlate(frame(spark, rows), c, [*RULES, *rules, c], TIMED).collect())


def test_event_count_expires_and_resets(spark):
    c = correlation("type: event_count\nrules: A\ngroup-by: user\ntimespan: 5m\ncondition:\n  gte: 3")
    assert alerts_of(spark, [(0, "A", "u", None), (1, "A", "u", None), (6.1, "A", "u", None)], c) == []
    assert [s for s, _ in alerts_of(spark, [(i / 60, "A", "u", None) for i in range(6)], c)] == [2, 5]
    between = correlation("type: event_count\nrules: A\ntimespan: 5m\ncondition:\n  gt: 1\n  lte: 3\n  neq: 2")
    assert [s for s, _ in alerts_of(spark, [(i, "A", "u", None) for i in range(4)], between)] == [2]


def test_value_count_ignores_absent_values(spark):
    c = correlation("type: value_count\nrules: [A, B]\ntimespan: 5m\ncondition:\n  gte: 2\n  field: user")
    assert [s for s, _ in alerts_of(spark, [(0, "A", "alice", None), (1, "B", None, None), (2, "A", "alice", None), (3, "A", "bob", None)], c)] == [3]


def test_temporal(spark):
    rows = [(0, "B", "u", None), (1, "A", "u", None), (2, "A", "v", None), (3, "B", "v", None), (20, "A", "w", None)]
    c = correlation("type: temporal\nrules: [A, B]\ngroup-by: user\ntimespan: 5m")
    assert alerts_of(spark, rows, c) == [(1, (("user", "u"),)), (3, (("user", "v"),))]
    ordered = correlation("type: temporal_ordered\nrules: [A, B]\ngroup-by: [user]\ntimespan: 5m")
    assert alerts_of(spark, rows, ordered) == [(3, (("user", "v"),))]
    twice = correlation("type: temporal_ordered\nrules: [A, A]\ngroup-by: [user]\ntimespan: 5m")
    assert [s for s, _ in alerts_of(spark, [(0, "A", "u", None), (1, "A", "u", None)], twice)] == [1]


def test_chained(spark):
    burst = correlation("type: event_count\nrules: A\ngroup-by: user\ntimespan: 9m\ncondition:\n  gte: 3", "burst")
    chain = correlation("type: temporal_ordered\nrules: [burst, B]\ngroup-by: user\ntimespan: 9m")
    rows = [(i, "A", "u", None) for i in range(3)] + [(4, "B", "v", None), (5, "B", "u", None)]
    assert alerts_of(spark, rows, chain, [burst]) == [(4, (("user", "u"),))]


def test_late_arrivals():
    """A at 2 s, then B at 1 s: no `A then B`; with the roles reversed it is one."""
    fold = CorrelationFold("temporal_ordered", 60 * S, 2)
    assert not fold.observe(2 * S, (0,), None) and not fold.observe(1 * S, (1,), None)
    fold = CorrelationFold("temporal_ordered", 60 * S, 2)
    assert not fold.observe(2 * S, (1,), None) and fold.observe(1 * S, (0,), None)
    fold = CorrelationFold("event_count", 60 * S, 1, (("gte", 2),))
    assert not fold.observe(100 * S, (0,), None) and not fold.observe(10 * S, (0,), None)


@pytest.mark.parametrize("bad", ["type: other\nrules: A\ntimespan: 1m", "type: event_count\nrules: A\ntimespan: 1m", "type: value_count\nrules: A\ntimespan: 1m\ncondition:\n  gte: 2", "type: temporal\nrules: []\ntimespan: 1m", "type: temporal\nrules: A", "type: temporal\nrules: [A, missing]\ntimespan: 1m", "type: temporal\nrules: [A, c]\ntimespan: 1m"])
def test_correlations_that_cannot_be_built(bad):
    c = correlation(bad)
    with pytest.raises(CorrelationError):
        resolve(c, [*RULES, c])


def test_own_aggregator(spark):
    ten = lambda df, agg, window, groups: df.withColumn("_value", F.lit(10.0))
    assert fired(spark, [(0, "A", "u", None)], "s:\n  kind: A\ncondition: s | count() > 9", aggregators={"count": ten}) == [0]
