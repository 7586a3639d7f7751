"""Streams give what batch gives on input in order; late events follow the folds."""

import random
import time
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest

from ruleforge.operators.correlate import correlate
from ruleforge.operators.detect import Bundle
from ruleforge.operators.folds import Average, CorrelationFold, Distinct, Extremum, LastSeen, TwoBucket
from ruleforge.operators.options import Options
from ruleforge.rules.reader import parse_rule, split_documents
from ruleforge.streaming.stateful import Expiry, _Processor, correlate_stream, detect_stream, dump, evaluate_stream, in_order, load

EVENTS = Options(time="ts", seq="event_id")


@pytest.fixture(scope="module")
def stream(spark, sf, tmp_path_factory):
    """events in time order as two files, read one a micro-batch; and the same as a table."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    cut = [0, len(events) // 2, len(events)]
    for i in range(2):
        spark.createDataFrame(events.iloc[cut[i] : cut[i + 1]], spark.read.parquet(f"{sf}/events.parquet").schema).coalesce(1).write.mode("append").parquet(folder)
    table = spark.read.parquet(folder)
    yield table, lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, df, tmp_path, name, endless_until=None):
    """endless_until: for a query that always has state to clean up, the number of rows after which it is stopped."""
    writer = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path))
    query = (writer if endless_until is not None else writer.trigger(availableNow=True)).start()
    try:
        if endless_until is None:
            assert query.awaitTermination(180)
        else:
            end = time.monotonic() + 120
            while spark.table(name).count() < endless_until and time.monotonic() < end and query.isActive:
                time.sleep(1)
    finally:
        query.stop()
    return spark.table(name)


def rule(text):
    return parse_rule("title: r\nname: r\ndetection:\n" + "\n".join("  " + x for x in text.splitlines()))


@pytest.mark.parametrize(
    ("name", "text", "expiry"),
    [
        ("count", "s:\n  event_type: error\ntimeframe: 3d\ncondition: s | count() by user_id > 2", Expiry()),
        ("distinct", "s:\n  value|gte: 0\ntimeframe: 1d\ncondition: s | count(event_type) by user_id >= 3", Expiry(watermark="1 minute")),
        ("max", "s:\n  event_type: purchase\ntimeframe: 1d\ncondition: s | max(value) by user_id > 100", Expiry(ttl=3_600_000_000)),
        ("near_b", "a:\n  event_type: error\nb:\n  event_type: signup\ntimeframe: 2h\ncondition: a | near b", Expiry(watermark="1 minute")),
    ],
)
def test_stream_equals_batch(spark, stream, tmp_path, name, text, expiry):
    table, source = stream
    r = rule(text)
    wanted = sorted(x.event_id for x in Bundle([r], EVENTS).detect(table).collect())
    found = run(spark, evaluate_stream(source(), r, EVENTS, expiry), tmp_path, f"s_{name}", len(wanted) if expiry.ttl else None)
    assert sorted(x.event_id for x in found.collect()) == wanted
    assert wanted
    assert found.columns == [*table.columns, "rule_id"]


def test_stateless_bundle(spark, stream, tmp_path):
    table, source = stream
    rules = [rule(f"s:\n  event_type: {t}\ncondition: s") for t in ("error", "click")]
    found = run(spark, detect_stream(source(), rules), tmp_path, "s_plain")
    assert found.count() == table.where("event_type IN ('error', 'click')").count()


BASE = "".join(f"title: {t}\nname: {t}\ndetection:\n  s:\n    event_type: {t}\n  condition: s\n---\n" for t in ("click", "error", "purchase", "signup"))


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("chained", "title: b\nname: b\ncorrelation:\n  type: event_count\n  rules: error\n  group-by: user_id\n  timespan: 5d\n  condition:\n    gte: 2\n---\ntitle: c\nname: c\ncorrelation:\n  type: temporal\n  rules: [b, purchase]\n  group-by: user_id\n  timespan: 9d\n"),
    ],
)
def test_correlation_stream_equals_batch(spark, stream, tmp_path, name, text):
    table, source = stream
    rules = [parse_rule(d) for d in split_documents(BASE + text)]
    found = run(spark, correlate_stream(source(), rules[-1], rules, EVENTS, Expiry(watermark="1 minute")), tmp_path, f"c_{name}")
    wanted = correlate(table, rules[-1], rules, EVENTS)
    key = lambda rows: sorted((r.event_id, sorted(r.group_values.items())) for r in rows)
    assert key(found.collect()) == key(wanted.collect())
    assert wanted.count() > 0


def test_state_round_trip():
    minute = 60_000_000
    folds = [(TwoBucket(minute), 1.0), (Average(minute), 2.0), (Distinct(minute), "x"), (Extremum(minute, 1), 3.0)]
    for fold, value in folds:
        for t in range(5):
            fold.add(t * minute // 2, value)
        again = load(type(fold)(minute, 1) if isinstance(fold, Extremum) else type(fold)(minute), dump(fold))
        assert again.add(3 * minute, value) == fold.add(3 * minute, value)
    c = CorrelationFold("event_count", minute, 1, (("gte", 3.0),))
    assert not c.observe(0, (0,), None)
    again = load(CorrelationFold("event_count", minute, 1, (("gte", 3.0),)), dump(c))
    assert not again.observe(1, (0,), None)
    assert again.observe(2, (0,), None)
    n = LastSeen(minute)
    n.see(5, ["a"], ["a"])
    assert load(LastSeen(minute), dump(n)).see(minute + 5, [], ["a"]) == {"a": True}


def test_a_rule_with_state_is_no_plain_stream(spark, stream):
    _, source = stream
    with pytest.raises(ValueError):
        detect_stream(source(), [rule("s:\n  event_type: error\ncondition: s | count() > 2")])
    with pytest.raises(ValueError):
        evaluate_stream(source(), rule("s:\n  event_type: error\ncondition: s"))


@pytest.mark.parametrize("run_bytes", [1 << 30, 4000, 300])
def test_order_of_rows_by_runs_on_disk(run_bytes):
    draw = random.Random(7)
    rows = [(draw.choice("ab"), draw.randrange(40), draw.randrange(3), f"{i}") for i in range(3000)]
    parts = [pa.table(dict(zip("kusx", map(list, zip(*rows[i : i + 100]))))) for i in range(0, len(rows), 100)]
    assert list(in_order(iter(parts), ["k", "u", "s"], run_bytes)) == sorted(rows, key=lambda r: r[:3])
    assert list(in_order(iter([]), ["k"], run_bytes)) == []


def test_one_group_is_not_in_memory_as_a_whole():
    before = pa.total_allocated_bytes()
    part = lambda i: pa.table({"k": [""] * 1000, "u": [(i * 7919 + j) % 100_003 for j in range(1000)], "x": [f"{i:0500}"] * 1000})
    most, last = 0, -1
    for n, (_, u, _) in enumerate(in_order(map(part, range(100)), ["k", "u"], 2_000_000), 1):
        assert u >= last
        last = u
        if n % 500 == 0:
            most = max(most, pa.total_allocated_bytes() - before)
    assert n == 100_000
    assert most < 8_000_000  # of 50 MB


class Lane:
    """The state store and the timers of a lane."""

    def __init__(self):
        self.folds, self.timers = {}, set()
        self.getMapState = lambda *_, **__: SimpleNamespace(exists=lambda: bool(self.folds), getValue=lambda k: self.folds.get(k), updateValue=self.folds.__setitem__, removeKey=self.folds.pop, iterator=lambda: iter(list(self.folds.items())))
        self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(list(self.timers)), self.timers.add, self.timers.discard


COUNT = pa.schema([("_key", pa.string()), ("_us", pa.int64()), ("_seq", pa.int64()), ("_arg", pa.float64()), ("_event", pa.string())])


def counter(every=False):
    """More than 2 in the estimate of a minute."""
    minute = 60_000_000
    made = _Processor(["_lane", *COUNT.names], COUNT, lambda: TwoBucket(minute), lambda fold, us, arg: fold.add(us, arg) > 2, minute, Expiry(watermark="1 minute"), every)
    lane = Lane()
    made.init(lane)
    return made, lane


def feed(made, rows):
    part = pd.DataFrame([(0, k, us, n, 1.0, f"{k}{n}") for n, (k, us) in enumerate(rows)])
    return list(made.handleInputRows((0,), iter([part]), None))


def test_groups_of_a_lane_share_a_frame():
    made, lane = counter()
    found = feed(made, [(f"g{i % 500}", i // 500) for i in range(1500)])
    assert [len(f) for f in found] == [500]
    assert set(found[0]._event) == {f"g{i % 500}{i}" for i in range(1000, 1500)}
    assert len(lane.folds) == 500
    assert len(lane.timers) == 1
    again = feed(made, [("g3", 10), ("new", 11)])
    assert list(again[0]._event) == ["g30"]
    assert sum(map(len, feed(counter(every=True)[0], [("a", 0), ("b", 1)]))) == 2


def test_idle_groups_of_a_lane_expire():
    made, lane = counter()
    feed(made, [("a", 0), ("b", 90_000_000)])
    assert lane.timers == {120_001}
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 130_000)
    assert list(made.handleExpiredTimer((0,), now, None)) == []
    assert list(lane.folds) == [("b",)]
    assert lane.timers == {120_001, 210_001}  # Spark drops the one that fired


def test_states_expire_on_a_stream(spark, tmp_path):
    r = rule("s:\n  event_type: error\ntimeframe: 1m\ncondition: s | count() by user_id > 1")
    minutes = [0, 0.5, 10, 10.5, 30, 30.2, 50, 90, 90.1]
    for i, m in enumerate(minutes):
        table = spark.createDataFrame([(i * 10 + u, 1_700_000_000_000_000 + int(m * 60_000_000) + u, u, "error") for u in range(3 + i % 2)], "event_id bigint, ts bigint, user_id bigint, event_type string")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(0.01)
    whole = spark.read.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    found = run(spark, evaluate_stream(source, r, EVENTS, Expiry(watermark="10 seconds")), tmp_path / "state", "s_expiry")
    wanted = Bundle([r], EVENTS).detect(whole)
    assert sorted(x.event_id for x in found.collect()) == sorted(x.event_id for x in wanted.collect())
    assert wanted.count() > 0
    left = spark.read.format("statestore").option("stateVarName", "folds").load(str(tmp_path / "state"))
    assert left.select("key").distinct().count() > 0
    assert left.count() <= 4


def test_calls_into_the_store_by_group_of_a_correlation():
    """A new group is one call; a known one is two. The lane has three more, whatever its groups are."""
    schema = pa.schema([("_key", pa.string()), ("_us", pa.int64()), ("_seq", pa.int64()), ("_refs", pa.list_(pa.int32())), ("_value", pa.string()), ("_event", pa.string())])
    made = _Processor(["_lane", *schema.names], schema, lambda: CorrelationFold("temporal_ordered", 1000, 2), lambda fold, us, refs, value: fold.observe(us, tuple(refs), value), 1000, Expiry(watermark="1 minute"), False)
    lane, calls = Lane(), []
    counted = lambda name, f: lambda *a: (calls.append(name), f(*a))[1]
    handle = SimpleNamespace(getMapState=lambda *a, **b: SimpleNamespace(**{k: counted(k, f) for k, f in vars(lane.getMapState()).items()}), listTimers=counted("listTimers", lane.listTimers), registerTimer=counted("registerTimer", lane.registerTimer))
    made.init(handle)
    part = lambda us, ref: pd.DataFrame([(0, f"g{i}", us, i, [ref], None, f"{us}-{i}") for i in range(400)])
    assert list(made.handleInputRows((0,), iter([part(5, 0)]), None)) == []
    assert sorted(calls) == ["exists", "listTimers", "registerTimer", *["updateValue"] * 400]
    calls.clear()
    [found] = made.handleInputRows((0,), iter([part(9, 1)]), None)
    assert set(found._event) == {f"9-{i}" for i in range(400)}
    assert sorted(calls) == ["exists", *["getValue"] * 400, "listTimers", *["updateValue"] * 400]
