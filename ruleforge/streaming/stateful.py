"""Rules on streams: aggregates, near and correlations as one state a group, fed by the folds that batch uses too.

Groups are dealt to a fixed number of lanes, and a lane is what Spark calls a group: a call into the state store, a
pandas frame and a timer cost a lane what they would cost each group. A lane has a map in the state store, from group
to its fold as JSON text, which holds what the window still covers. Rows of a micro-batch are fed group after group in
the order (time, seq); a lane sorts them in runs on disk, so neither a hot group nor a rule without groups is in memory
as a whole. Later ones may still be late, and the folds say what that means. Rows of a stream that take part come out
again with whether they fired, so that a correlation can feed another one.

States expire: with a watermark, `idle` windows after the last event of a group its state may go, and a timer in event
time clears a lane of such states, once a window at most; without one, `ttl` (microseconds, in processing time) does,
and with neither the state stays. (With a ttl Spark has always something to clean up, so a query with the availableNow
trigger doesn't end by itself.) What expires can't change a result of events that are in time.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields
from heapq import merge
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ruleforge.functions.gotext import go_text
from ruleforge.operators import folds
from ruleforge.operators.correlate import resolve
from ruleforge.operators.detect import Bundle, CompileError, is_stateful, match_column
from ruleforge.operators.options import Options
from ruleforge.operators.search import true_or_false
from ruleforge.operators.windows import TESTS, aggregate_input
from ruleforge.rules.condition import Aggregate, And, Name, Near, Not, Or, Quantified, search_names
from ruleforge.rules.model import Rule

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Part of the state's layout: a stream that goes on from a checkpoint must find its groups in the same lanes.
LANES = 1024
#: Bytes of rows that a lane sorts at once, rows of a block of a sorted run, rows of an output frame.
RUN_BYTES, BLOCK, FRAME = 32 << 20, 1000, 10_000
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Expiry:
    """watermark: how late events may be ("10 minutes"), of the options' time column; idle: windows until a state goes; ttl: microseconds."""

    watermark: str | None = None
    idle: int = 2
    ttl: int | None = None


def dump(fold: object) -> str:
    """A fold as JSON text."""

    def plain(x):
        if hasattr(x, "__dataclass_fields__"):
            return {f.name: plain(getattr(x, f.name)) for f in fields(x)}
        if isinstance(x, dict):
            return {"items": [[k, plain(v)] for k, v in x.items()]}
        return [plain(v) for v in x] if isinstance(x, list | tuple | folds.deque) else x

    return json.dumps(plain(fold))


def load(fold: object, text: str) -> object:
    """A fresh fold with the content that dump wrote."""

    def back(now, x):
        if hasattr(now, "__dataclass_fields__"):
            for f in fields(now):
                setattr(now, f.name, back(getattr(now, f.name), x[f.name]))
            return now
        if isinstance(now, dict):
            return dict(x["items"])
        if isinstance(now, folds.deque):
            return folds.deque(tuple(v) for v in x)
        return [tuple(tuple(w) if isinstance(w, list) else w for w in v) for v in x] if isinstance(now, list) else x

    return back(fold, json.loads(text))


def _tuples(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def in_order(parts: Iterable[pa.Table], by: list[str], run_bytes: int = RUN_BYTES) -> Iterator[tuple]:
    """The rows of parts as tuples, ordered by the first columns, which are `by`; equal ones as they came.

    Up to run_bytes are sorted in memory. More go to a file in sorted runs, which are then merged block by block.
    """
    held, size, runs, schema = [], 0, [], None
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:

        def ordered() -> list[pa.RecordBatch]:
            return pa.concat_tables(held).sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches(max_chunksize=BLOCK)

        def spill() -> None:
            run = []
            for block in ordered():
                run.append((file.tell(), file.write(block.serialize())))
            runs.append(run)
            held.clear()

        def read(run: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, length in run:
                file.seek(at)
                yield from _tuples(pa.ipc.read_record_batch(pa.py_buffer(file.read(length)), schema))

        for part in parts:
            schema = part.schema
            held.append(part)
            size += part.nbytes
            if size >= run_bytes:
                spill()
                size = 0
        if held and not runs:
            for block in ordered():
                yield from _tuples(block)
            return
        if held:
            spill()
        yield from merge(*map(read, runs), key=lambda r: r[: len(by)])


class _Processor(StatefulProcessor):
    """Feeds the rows of a lane to the folds of their groups; `step` tells whether a row fires.

    names: the columns as they arrive. schema: those of them that are used: _key, _us, _seq, the inputs of step, _event.
    every: whether rows that don't fire come out too.
    """

    def __init__(self, names: list[str], schema: pa.Schema, make: Callable[[], object], step: Callable[..., bool], window: int, expiry: Expiry, every: bool) -> None:
        self.names, self.schema, self.make, self.step, self.window, self.expiry, self.every = names, schema, make, step, window, expiry, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": max(1, self.expiry.ttl // 1000)} if self.expiry.ttl and not self.expiry.watermark else {}
        self.state = handle.getMapState("folds", "key string", "content string, until bigint", **ttl)

    def _table(self, part: pd.DataFrame) -> pa.Table:
        part = part.set_axis(self.names, axis=1)  # names that start with _ don't arrive
        return pa.Table.from_arrays([pa.array(part[f.name], f.type, from_pandas=not pa.types.is_floating(f.type)) for f in self.schema], schema=self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        first, out = None, []
        for group, found in groupby(in_order((self._table(p) for p in rows if len(p)), ["_key", "_us", "_seq"]), key=lambda r: r[0]):
            fold, until = self.make(), 0
            old = self.state.getValue((group,)) if known else None
            if old is not None:
                load(fold, old[0])
                until = old[1]
            us = 0
            for _, us, _, *inputs, event in found:
                fired = bool(self.step(fold, us, *inputs))
                if fired or self.every:
                    out.append((event, us, fired))
                    if len(out) == FRAME:
                        yield self._frame(out)
                        out = []
            until = max(until, us // 1000 + self.expiry.idle * self.window // 1000 + 1)
            self.state.updateValue((group,), (dump(fold), until))
            first = until if first is None else min(first, until)
        if first is not None and self.expiry.watermark and not list(self.handle.listTimers()):
            self.handle.registerTimer(first)
        if out:
            yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        events, us, fired = zip(*out, strict=True)
        return pd.DataFrame({"_event": events, "_time": pd.to_datetime(pd.Series(us, dtype="int64"), unit="us"), "_fired": fired})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over, first = [], None
        for (group,), (_, until) in self.state.iterator():
            if until <= now:
                over.append(group)
            else:
                first = until if first is None else min(first, until)
        for group in over:
            self.state.removeKey((group,))
        if first is not None:
            self.handle.registerTimer(max(first, now + self.window // 1000 + 1))
        yield from ()

    def close(self) -> None:
        pass


def _fold(df: DataFrame, keys: list[Column], inputs: dict[str, Column], make: Callable[[], object], step: Callable[..., bool], window: int, expiry: Expiry, every: bool = False, may: Column | None = None) -> DataFrame:
    """df with _fired; only rows that fire, or every one. df has _us, _seq and, with a watermark, _time.

    step takes the fold, the time and the inputs. may: which rows can fire, where only those come out.
    """
    if df.sparkSession.conf.get(_PROVIDER) != ROCKSDB:
        df.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    schema = df.schema
    key = F.coalesce(F.to_json(F.array(*[F.coalesce(k, F.lit("\x00")) for k in keys])), F.lit("")) if keys else F.lit("")
    last = F.lit((1 << 63) - 1)  # rows without a number go last
    event = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _TIMES)
    event = event if may is None else F.when(may, event)
    used = df.select(key.alias("_key"), "_us", F.coalesce("_seq", last).alias("_seq"), *[c.alias(n) for n, c in inputs.items()], event.alias("_event"), *(["_time"] if expiry.watermark else []))
    packed = used.select(F.pmod(F.xxhash64("_key"), F.lit(LANES)).cast("int").alias("_lane"), *used.columns)
    arrow = to_arrow_schema(used.drop("_time").schema)
    out = packed.groupBy("_lane").transformWithStateInPandas(_Processor(packed.columns, arrow, make, step, window, expiry, every), outputStructType="_event string, _time timestamp, _fired boolean", outputMode="Append", timeMode="EventTime" if expiry.watermark else "ProcessingTime" if expiry.ttl else "None", **({"eventTimeColumnName": "_time"} if expiry.watermark else {}))
    back = out.select(F.from_json("_event", schema, _TIMES).alias("_e"), "_time", "_fired")
    return back.select(*[F.col("_e").getField(c).alias(c) for c in df.columns if c != "_time"], "_time", "_fired")


def _timed(df: DataFrame, options: Options, expiry: Expiry) -> DataFrame:
    us = options.micros(df)
    df = df.withColumns({"_us": us, "_seq": options.order(df), "_time": F.timestamp_micros(us)})
    return df.withWatermark("_time", expiry.watermark) if expiry.watermark else df


def detect_stream(df: DataFrame, rules: list[Rule], options: Options | None = None) -> DataFrame:
    """Rules without state on a stream: the event's columns and rule_id."""
    if some := [r.key for r in rules if is_stateful(r)]:
        raise CompileError(f"rules with state go to evaluate_stream: {', '.join(some)}")
    return Bundle(rules, options or Options()).detect(df)


def _aggregate_step(op: str, threshold: float) -> Callable[..., bool]:
    test = TESTS[op]
    return lambda fold, us, arg: test(fold.add(us, arg), threshold)


def _truth(node: object, known: dict[str, bool], names: list[str]) -> bool:
    """A search expression over known results, as near needs it for each event."""
    if isinstance(node, And):
        return all(_truth(n, known, names) for n in node.nodes)
    if isinstance(node, Or):
        return any(_truth(n, known, names) for n in node.nodes)
    if isinstance(node, Not):
        return not _truth(node.node, known, names)
    if isinstance(node, Quantified):
        some = [known.get(n, False) for n in search_names(node, names)]
        return all(some) if node.every and node.kind != "name" else any(some)
    return isinstance(node, Name) and known.get(node.name, False)


def evaluate_stream(df: DataFrame, rule: Rule, options: Options | None = None, expiry: Expiry | None = None) -> DataFrame:
    """The events of a stream on which a rule with one condition over an aggregate or near fires: the event's columns and rule_id.

    Groups are those of the aggregate. `near` has none: its last matches are one small state, which all events that
    match a search of the rule pass through.
    """
    options, expiry = options or Options(), expiry or Expiry()
    if len(rule.detection.conditions) != 1 or not is_stateful(rule):
        raise CompileError(f"{rule.key}: one condition with an aggregate is needed")
    condition, columns = rule.detection.conditions[0], df.columns
    timed = _timed(df, options, expiry)
    compiler = options.compiler(timed)
    searches = compiler.searches(rule)
    base = true_or_false(compiler.condition(condition.search, searches))
    if isinstance(condition.aggregation, Near):
        node, all_names = condition.aggregation.node, list(searches)
        names = [n for n in search_names(node, all_names) if n in searches]
        window = rule.detection.timeframe
        inputs = {"_base": base} | {f"_m{i}": true_or_false(searches[n]) for i, n in enumerate(names)}

        def near(fold: folds.LastSeen, us: int, matches: bool, *matched: bool) -> bool:
            known = fold.see(us, [n for n, m in zip(names, matched, strict=True) if m], names)
            return bool(matches) and _truth(node, known, all_names)

        part = base
        for n in names:
            part = part | true_or_false(searches[n])
        found = _fold(timed.where(part), [], inputs, lambda: folds.LastSeen(window), near, window if window > 0 else 0, replace_idle(expiry, window), may=base)
    else:
        agg: Aggregate = condition.aggregation
        window = rule.detection.timeframe if rule.detection.timeframe > 0 else options.window
        hit, arg, func = aggregate_input(agg, base, compiler)
        keys = [go_text(v.col, v.kind) for v in map(compiler.fields.direct, agg.group)]
        found = _fold(timed.where(hit), keys, {"_arg": arg}, lambda: folds.aggregate_fold(func, window), _aggregate_step(agg.op, float(agg.threshold)), window, expiry)
    return found.where("_fired").select(*[F.col(f"`{c}`") for c in columns], F.lit(rule.key).alias("rule_id"))


def replace_idle(expiry: Expiry, window: int) -> Expiry:
    """Without a timeframe a last match counts for ever, so its state doesn't expire."""
    return expiry if window > 0 else Expiry(None, expiry.idle, None)


def _flagged(df: DataFrame, rule: Rule, rules: list[Rule], options: Options, expiry: Expiry, depth: str) -> tuple[DataFrame, str, list[str]]:
    """df with a boolean column of whether the correlation fires on the event, and text columns of its group."""
    c = rule.correlation
    hits, made = [], {}
    for i, r in enumerate(resolve(rule, rules)):
        if r.correlation is not None:
            df, fired, groups = _flagged(df, r, rules, options, expiry, f"{depth}_{i}")
            made[len(hits)] = (fired, dict(zip(r.correlation.group_by, groups)))
            hits.append((r, fired))
        elif is_stateful(r):
            raise CompileError(f"{rule.key}: {r.key} has state; on streams correlations refer to rules without aggregates and to correlations")
        else:
            name = f"_h{depth}_{i}"
            df = df.withColumn(name, true_or_false(match_column(df, r, options)))
            hits.append((r, name))
    fields_ = options.compiler(df).fields
    texts = []
    for name in c.group_by:
        own = c.aliases.get(name, {})
        text: Column = F.lit(None).cast("string") if own else fields_.direct(name).text
        for r, h in reversed(hits):
            alias = own.get(r.name) or own.get(r.id)
            if alias:
                text = F.when(F.col(h), fields_.direct(alias).text).otherwise(text)
        for fired, values in made.values():
            if name in values:
                text = F.when(F.col(fired), F.col(values[name])).otherwise(text)
        texts.append(text)
    groups = [f"_k{depth}_{g}" for g in range(len(texts))]
    df = df.withColumns(dict(zip(groups, texts))) if groups else df
    some = F.lit(False)
    for _, h in hits:
        some = some | F.col(h)
    kind, span, count, condition = c.type, c.timespan, len(c.rules), c.condition
    value = fields_.direct(c.condition_field).text if kind == "value_count" else F.lit(None).cast("string")
    refs = F.array_compact(F.array(*[F.when(F.col(h), F.lit(i)) for i, (_, h) in enumerate(hits)]))

    def step(fold: folds.CorrelationFold, us: int, refs: list[int], value: str | None) -> bool:
        return fold.observe(us, tuple(refs), value)

    fired = f"_f{depth}"
    fed = _fold(df.where(some), [F.col(g) for g in groups], {"_refs": refs, "_value": value}, lambda: folds.CorrelationFold(kind, span, count, condition), step, span, expiry, every=depth != "").withColumnRenamed("_fired", fired)
    others = df.where(~some).withColumn(fired, F.lit(False))
    return (fed if depth == "" else fed.unionByName(others.select(*fed.columns))), fired, groups


def correlate_stream(df: DataFrame, rule: Rule, rules: list[Rule], options: Options | None = None, expiry: Expiry | None = None) -> DataFrame:
    """The events of a stream on which a correlation fires: the event's columns, rule_id and group_values."""
    options, expiry = options or Options(), expiry or Expiry()
    columns = df.columns
    found, fired, groups = _flagged(_timed(df, options, expiry), rule, rules, options, expiry, "")
    pairs = [x for g, name in zip(groups, rule.correlation.group_by, strict=True) for x in (F.lit(name), F.col(g))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return found.where(F.col(fired)).select(*[F.col(f"`{c}`") for c in columns], F.lit(rule.key).alias("rule_id"), values.alias("group_values"))
