"""Correlations: ordered folds over the matches of other rules, one for each group, that empty when they fire.

Only events that match a referenced rule are shuffled. Rows are dealt by group, sorted by time and streamed through
the fold, so a group is never in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleforge.rules.model import Correlation, Rule

from .detect import evaluate, is_stateful, match_column
from .folds import CorrelationFold
from .options import Options

TYPES = ("event_count", "value_count", "temporal", "temporal_ordered")


class CorrelationError(ValueError):
    """A correlation that can't be built."""


def resolve(rule: Rule, rules: list[Rule], chain: tuple[str, ...] = ()) -> list[Rule]:
    """The rules that a correlation refers to, checked: types, conditions, timespan, unknown names, cycles."""
    c = rule.correlation
    if c is None or c.type not in TYPES:
        raise CorrelationError(f"{rule.key}: unknown correlation type {c.type if c else None!r}")
    if c.type in ("event_count", "value_count") and not c.condition:
        raise CorrelationError(f"{rule.key}: {c.type} needs a condition")
    if c.type == "value_count" and not c.condition_field:
        raise CorrelationError(f"{rule.key}: value_count needs a field")
    if c.timespan <= 0:
        raise CorrelationError(f"{rule.key}: the timespan is not positive")
    if not c.rules:
        raise CorrelationError(f"{rule.key}: no rules")
    found = []
    for name in c.rules:
        known = next((r for r in rules if name and name in (r.name, r.id)), None)
        if known is None:
            raise CorrelationError(f"{rule.key}: unknown rule {name!r}")
        if known.correlation is not None:
            if known.key in chain or known.key == rule.key:
                raise CorrelationError(f"{rule.key}: a cycle through {name!r}")
            resolve(known, rules, (*chain, rule.key))
        found.append(known)
    return found


def _keyed(df: DataFrame, rule: Rule, rules: list[Rule], options: Options) -> tuple[DataFrame, list[str]]:
    """Events that match a reference, with _refs (their indexes), _value and a text column for each group field."""
    c: Correlation = rule.correlation
    referred = resolve(rule, rules)
    fields = options.compiler(df).fields
    base, hits, made = df, [], {}
    for i, r in enumerate(referred):
        name = f"_h{i}"
        if r.correlation is not None:
            fires = _fires(df, r, rules, options, []).select(F.col("_us").alias("_fu"), F.col("_seq").alias("_fs"), F.col("group_values").alias(f"_gv{i}")).dropDuplicates(["_fu", "_fs"])
            base = base.join(fires, (base["_us"] == fires["_fu"]) & (base["_seq"] == fires["_fs"]), "left").drop("_fu", "_fs")
            base = base.withColumn(name, F.col(f"_gv{i}").isNotNull())
            made[i] = f"_gv{i}"
        elif is_stateful(r):
            base = evaluate(base, r, options).drop("search_results", "condition_results").withColumnRenamed("match", name)
        else:
            base = base.withColumn(name, F.coalesce(match_column(df, r, options), F.lit(False)))
        hits.append(name)
    some = F.lit(False)
    for h in hits:
        some = some | F.col(h)
    base = base.where(some)
    groups: dict[str, Column] = {}
    for g, name in enumerate(c.group_by):
        own = c.aliases.get(name, {})
        value = None
        if own:
            for h, r in zip(hits, referred, strict=True):
                alias = own.get(r.name) or own.get(r.id)
                if alias:
                    text = fields.direct(alias).text
                    value = F.when(F.col(h), text) if value is None else value.when(F.col(h), text)
        text = fields.direct(name).text if value is None else value.otherwise(fields.direct(name).text) if not own else value
        for i, column in made.items():  # a child that fires says what the group is
            text = F.when(F.coalesce(F.map_contains_key(F.col(column), F.lit(name)), F.lit(False)), F.try_element_at(F.col(column), F.lit(name))).otherwise(text)
        groups[f"_k{g}"] = text
    value = fields.direct(c.condition_field).text if c.type == "value_count" else F.lit(None).cast("string")
    refs = F.array_compact(F.array(*[F.when(F.col(h), F.lit(i)) for i, h in enumerate(hits)]))
    return base.withColumns(groups | {"_refs": refs, "_value": value}), list(groups)


def _fires(df: DataFrame, rule: Rule, rules: list[Rule], options: Options, columns: list[str]) -> DataFrame:
    """_us, _seq, group_values and the named columns of the events on which a correlation fires. df has _us and _seq.

    An event travels through the fold as it is, so events of one time and number are never taken for one another.
    """
    c: Correlation = rule.correlation
    keyed, groups = _keyed(df, rule, rules, options)
    kind, span, count, condition = c.type, c.timespan, len(c.rules), c.condition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = object(), None
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(g).to_pylist() for g in groups), strict=True)) if groups else [()] * batch.num_rows
            rows = zip(keys, batch.column("_us").to_pylist(), batch.column("_refs").to_pylist(), batch.column("_value").to_pylist(), strict=True)
            for i, (key, us, refs, value) in enumerate(rows):
                if key != now:
                    now, fold = key, CorrelationFold(kind, span, count, condition)
                if fold.observe(us, tuple(refs), value):
                    out.append(i)
            yield batch.select(["_us", "_seq", *groups, "_event"]).take(pa.array(out, pa.int32()))

    event = F.struct(*[F.col(f"`{n}`") for n in columns]) if columns else F.lit(True)
    narrow = keyed.select("_us", "_seq", *groups, "_refs", "_value", event.alias("_event"))
    # without group fields there is one bucket, and its order is total; what comes before stays in parallel
    dealt = narrow.repartition(*groups) if groups else narrow.repartition(1)
    shown = dealt.select("_us", "_seq", *groups, "_event").schema
    found = dealt.sortWithinPartitions(*groups, "_us", "_seq").mapInArrow(run, shown)
    pairs = [x for g, name in zip(groups, c.group_by, strict=True) for x in (F.lit(name), F.col(g))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return found.select("_us", "_seq", values.alias("group_values"), *(["_event.*"] if columns else []))


def correlate(df: DataFrame, rule: Rule, rules: list[Rule], options: Options | None = None) -> DataFrame:
    """The events on which a correlation fires: the event's columns, rule_id and group_values.

    Events go by (time, seq). Where a rule that it refers to is a correlation itself, (time, seq) names the events that
    fire there; events that share both are then taken for one.
    """
    options = options or Options()
    columns = df.columns
    timed = df.withColumns({"_us": options.micros(df), "_seq": options.order(df)})
    fires = _fires(timed, rule, rules, options, columns)
    return fires.select(*[F.col(f"`{c}`") for c in columns], F.lit(rule.key).alias("rule_id"), "group_values")
