"""Evaluation of one rule or a bundle of rules over a frame of events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleforge.rules.condition import Near, search_names
from ruleforge.rules.model import Rule

from .near import add_near
from .options import Options
from .search import CompileError, Compiler, ahocorasick, texts_found, true_or_false
from .windows import add_aggregate


def _timed(df: DataFrame, options: Options) -> DataFrame:
    return df.withColumns({"_us": options.micros(df), "_seq": options.order(df)})


def is_stateful(rule: Rule) -> bool:
    return any(c.aggregation for c in rule.detection.conditions)


def match_column(df: DataFrame, rule: Rule, options: Options | None = None) -> Column:
    """The match of a rule without aggregates as one predicate, null for no match; it can be pushed to the scan."""
    if is_stateful(rule):
        raise CompileError(f"{rule.key}: aggregates need evaluate() or detect()")
    compiler = (options or Options()).compiler(df)
    searches = compiler.searches(rule)
    out = F.lit(False)
    for c in rule.detection.conditions:
        out = out | compiler.condition(c.search, searches)
    return out


def _with_conditions(df: DataFrame, rule: Rule, options: Options) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Adds a boolean column for each condition."""
    compiler = options.compiler(df)
    searches = compiler.searches(rule)
    names = []
    for i, c in enumerate(rule.detection.conditions):
        out = f"_c{i}"
        base = compiler.condition(c.search, searches)
        if c.aggregation is None:
            df = df.withColumn(out, true_or_false(base))
        elif isinstance(c.aggregation, Near):
            df = add_near(df, base, c.aggregation, rule.detection.timeframe, searches, compiler, out)
        else:
            window = rule.detection.timeframe if rule.detection.timeframe > 0 else options.window
            df = add_aggregate(df, base, c.aggregation, window, compiler, options, out)
        names.append(out)
    return df, searches, names


def evaluate(df: DataFrame, rule: Rule, options: Options | None = None) -> DataFrame:
    """Every event with match, search_results (by search) and condition_results.

    With lazy, search_results has only the searches that the conditions name.
    """
    options = options or Options()
    columns = df.columns
    timed = _timed(df, options) if is_stateful(rule) else df
    out, searches, names = _with_conditions(timed, rule, options)
    if options.lazy:
        used = {n for c in rule.detection.conditions for n in search_names(c.search, list(searches)) + (search_names(c.aggregation.node, list(searches)) if isinstance(c.aggregation, Near) else [])}
        searches = {n: s for n, s in searches.items() if n in used}
    found = F.create_map(*[x for n, s in searches.items() for x in (F.lit(n), true_or_false(s))]) if searches else F.create_map().cast("map<string,boolean>")
    match = F.lit(False)
    for n in names:
        match = match | F.col(n)
    results = F.array(*names) if names else F.array().cast("array<boolean>")
    return out.select(*[F.col(f"`{c}`") for c in columns], match.alias("match"), found.alias("search_results"), results.alias("condition_results"))


@dataclass
class Bundle:
    """Many rules evaluated together. Rules that don't compile are in skipped_rules with the reason."""

    rules: list[Rule]
    options: Options = field(default_factory=Options)
    skipped_rules: dict[str, str] = field(default_factory=dict)
    #: Texts that rules without state look for in a field from which one automaton finds them all in a pass.
    needles: int = 64

    def _shared(self, df: DataFrame) -> tuple[DataFrame, Compiler]:
        """df and a compiler for the rules without state; where a field is searched for many texts, df has a column of those found in one pass."""
        compiler = self.options.compiler(df)
        fields = [f for r in self.rules for search in r.detection.searches.values() for fields in search.matchers or () for f in fields]
        if sum(len(f.values) for f in fields if "contains" in f.modifiers) < self.needles:
            return df, compiler
        compiler.asked = {}
        self._usable(df, self.rules, compiler)
        shared = self.options.compiler(df)
        for key, (text, needles) in compiler.asked.items():
            if len(needles) >= self.needles and ahocorasick is not None:
                name = f"_needles{len(shared.shared)}"
                df = df.withColumn(name, texts_found(text, sorted(needles)))
                shared.shared[key] = (name, {n: i for i, n in enumerate(sorted(needles))})
        return df, shared

    def _usable(self, df: DataFrame, rules: list[Rule], compiler: Compiler | None = None) -> list[tuple[Rule, Column | None]]:
        compiler, out = compiler or self.options.compiler(df), []
        for r in rules:
            try:
                searches = compiler.searches(r)
                if is_stateful(r):
                    out.append((r, None))
                    continue
                match = F.lit(False)
                for c in r.detection.conditions:
                    match = match | compiler.condition(c.search, searches)
                out.append((r, match))
            except ValueError as e:
                self.skipped_rules[r.key] = str(e)
        return out

    def results(self, df: DataFrame) -> DataFrame:
        """A row for each event and rule that compiles: the event's columns, rule_id, match."""
        columns, parts = df.columns, []
        wide, compiler = self._shared(df)
        usable = self._usable(df, self.rules, compiler)
        plain = [(r, true_or_false(m)) for r, m in usable if m is not None]
        if plain:
            found = F.array(*[F.struct(F.lit(r.key).alias("rule_id"), m.alias("match")) for r, m in plain])
            parts.append(wide.select(*[F.col(f"`{c}`") for c in columns], F.explode(found).alias("_r")).select(*[F.col(f"`{c}`") for c in columns], "_r.rule_id", "_r.match"))
        for r, m in usable:
            if m is None:
                parts.append(evaluate(df, r, self.options).select(*[F.col(f"`{c}`") for c in columns], F.lit(r.key).alias("rule_id"), "match"))
        return _union(df, parts, "rule_id string, match boolean")

    def detect(self, df: DataFrame, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
        """A row for each event and rule that matches it: the event's columns and rule_id.

        All rules without aggregates take one scan. before, after: further predicates by rule key, applied ahead of
        the rule's own, or on its matches (state then includes the events that they drop).
        """
        columns, parts = df.columns, []
        wide, compiler = self._shared(df)
        usable = self._usable(df, self.rules, compiler)
        plain = [(r, m & (before or {})[r.key] if r.key in (before or {}) else m) for r, m in usable if m is not None]
        plain = [(r, m & (after or {})[r.key] if r.key in (after or {}) else m) for r, m in plain]
        if plain:
            hits = F.array_compact(F.array(*[F.when(m, F.lit(r.key)) for r, m in plain]))
            parts.append(wide.select(*[F.col(f"`{c}`") for c in columns], F.explode(hits).alias("rule_id")))
        for r, m in usable:
            if m is None:
                found = _stateful_matches(df, r, self.options)
                if r.key in (after or {}):
                    found = found.where((after or {})[r.key])
                parts.append(found.select(*[F.col(f"`{c}`") for c in columns], F.lit(r.key).alias("rule_id")))
        return _union(df, parts, "rule_id string")


def _stateful_matches(df: DataFrame, rule: Rule, options: Options) -> DataFrame:
    """The events that a rule with aggregates matches; events that can't take part are dropped before any shuffle."""
    compiler = options.compiler(df)
    searches = compiler.searches(rule)
    part = F.lit(False)
    for c in rule.detection.conditions:
        part = part | compiler.condition(c.search, searches)
        if isinstance(c.aggregation, Near):
            for n in search_names(c.aggregation.node, list(searches)):
                part = part | searches.get(n, F.lit(False))
    out, _, names = _with_conditions(_timed(df.where(part), options), rule, options)
    match = F.lit(False)
    for n in names:
        match = match | F.col(n)
    return out.where(match)


def _union(df: DataFrame, parts: list[DataFrame], more: str) -> DataFrame:
    if not parts:
        empty = df.limit(0)
        for item in more.split(", "):
            name, kind = item.split()
            empty = empty.withColumn(name, F.lit(None).cast(kind))
        return empty
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect(df: DataFrame, rules: list[Rule], options: Options | None = None) -> DataFrame:
    """The matches of rules: the event's columns and rule_id."""
    return Bundle(rules, options or Options()).detect(df)
