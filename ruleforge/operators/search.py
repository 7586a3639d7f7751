"""Searches and conditions compiled to boolean columns.

Inside, null stands for false: and/or keep it harmless and let plain comparisons reach the scan; whatever is negated
is made false first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleforge.functions import patterns
from ruleforge.functions.comparators import COMPARATORS, EVENT_MODIFIERS, Mode, Value, compare_fields, local_time
from ruleforge.functions.gotext import go_text
from ruleforge.functions.literals import COLUMN_MODIFIERS, VALUE_MODIFIERS, BadValue, Expander, candidates, expand_values
from ruleforge.rules import condition as c
from ruleforge.rules.model import FieldMatcher, Rule, Search

from .fields import Fields, column

try:
    import ahocorasick
except ImportError:  # each text is then looked for by itself
    ahocorasick = None

_FLAGS = {"i": "i", "ignorecase": "i", "m": "m", "multiline": "m", "s": "s", "dotall": "s"}
_APART = ("exists", "fieldref", "neq", "expand")


class CompileError(ValueError):
    """A rule that can't be compiled."""


def true_or_false(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def texts_found(text: Column, needles: list[str]) -> Column:
    """The places in needles of those that a text holds, by one automaton for all of them."""

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for i, n in enumerate(needles):
            automaton.add_word(n, i)
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else sorted({i for _, i in automaton.iter(t)}))

    return found(text)


@dataclass
class Compiler:
    """Compiles the searches of rules against fields. Equal leaves are made once.

    asked: if not None, gets for each text column that is searched for plain texts the column and these texts.
    shared: for such columns the name of a column of found texts (see texts_found) and the texts' places.
    """

    fields: Fields
    expander: Expander | None = None
    case_sensitive: bool = False
    leaves: dict = field(default_factory=dict)
    asked: dict | None = None
    shared: dict = field(default_factory=dict)

    def search(self, s: Search) -> Column:
        """The column of a search; an empty one holds."""
        if s.keywords:
            return self.keywords(s.keywords)
        if not s.matchers:
            return F.lit(True)
        return any_of([all_of([self.leaf(f) for f in fields]) for fields in s.matchers])

    def leaf(self, f: FieldMatcher) -> Column:
        """One field|modifiers: values."""
        key = (f.field, f.modifiers, tuple(map(repr, f.values)))
        if key not in self.leaves:
            self.leaves[key] = self._leaf(f)
        return self.leaves[key]

    def _leaf(self, f: FieldMatcher) -> Column:
        modifiers = list(f.modifiers)
        every = bool(modifiers) and modifiers[-1] == "all"
        if every:
            modifiers.pop()
        apart = {m for m in modifiers if m in _APART}
        modifiers = [m for m in modifiers if m not in _APART]
        try:
            values = expand_values(f.values, self.expander, "expand" in apart)
        except BadValue as e:
            raise CompileError(str(e)) from e
        if "exists" in apart:
            wanted = [v.lower() == "true" for v in values]
            parts = [self.fields.present(f.field) if w else ~self.fields.present(f.field) for w in wanted]
            found = all_of(parts) if every else any_of(parts)
        else:
            found = self._compared(f, modifiers, values, every, "fieldref" in apart)
        return ~true_or_false(found) if "neq" in apart else found

    def _compared(self, f: FieldMatcher, modifiers: list[str], values: list[str], every: bool, by_field: bool) -> Column:
        cased = "cased" in modifiers
        modifiers = [m for m in modifiers if m != "cased"]
        kept, flags = [], ""
        for i, m in enumerate(modifiers):
            if m in _FLAGS and (i and (modifiers[i - 1] == "re" or modifiers[i - 1] in _FLAGS)):
                flags += _FLAGS[m]
            else:
                kept.append(m)
        name, chain, parts_of = "", [], []
        for m in kept:
            if m in VALUE_MODIFIERS:
                chain.append(m)
            elif m in EVENT_MODIFIERS:
                parts_of.append(m)
            elif m in COMPARATORS and m:
                if name:
                    raise CompileError(f"two comparators: {name} and {m}")
                name = m
            else:
                raise CompileError(f"unknown modifier {m!r} of {f.field!r}")
        mode = Mode(cased or self.case_sensitive and name != "", "".join(sorted(set(flags))))
        if by_field:
            tests = [[(lambda v, o=o: self._referred(name, v, o, chain, mode)) for o in self._candidates(ref)] for ref in values]
        else:
            tests = [[(lambda v, t=t: COMPARATORS[name](v, t, mode)) for t in candidates(value, chain) if t is not None] for value in values]
        actual = self.fields.values(f.field)
        if name == "contains" and not (parts_of or by_field):
            parts = [any_of([self._on(v, flat, parts_of, lambda v, t=t: COMPARATORS[name](v, t, mode)) if flat else self._held(f.field, k, v, t, mode) for t in candidates(value, chain) if t is not None for k, (v, flat) in enumerate(actual)]) for value in values]
            return all_of(parts) if every else any_of(parts)
        if name == "" and not (chain or parts_of or by_field or every) and len(actual) == 1 and not actual[0][1] and len(values) > 8 and not any(patterns.has_wildcard(x) or x == "null" or not x.isascii() for x in values):
            # many plain texts are one set lookup
            text, texts = actual[0][0].text, [patterns.literal(x) for x in values]
            return text.isin(texts) if mode.cased else F.lower(text).isin([t.lower() for t in texts])
        parts = [any_of([self._on(v, flat, parts_of, t) for t in some for v, flat in actual]) for some in tests]
        return all_of(parts) if every else any_of(parts)

    def _held(self, name: str, target: int, v: Value, text: str, mode: Mode) -> Column:
        """Whether a value contains a text: from the texts found in one pass, if they are shared."""
        plain = patterns.literal(text)
        if patterns.has_wildcard(text) or not plain:
            return COMPARATORS["contains"](v, text, mode)
        key, plain = (name, target, mode.cased), plain if mode.cased else plain.lower()
        if self.asked is not None:
            self.asked.setdefault(key, (v.text if mode.cased else F.lower(v.text), set()))[1].add(plain)
        if key in self.shared:
            shared, places = self.shared[key]
            return F.array_contains(F.col(shared), places[plain])
        return COMPARATORS["contains"](v, text, mode)

    def _candidates(self, name: str) -> list[Value]:
        return [v for v, _ in self.fields.values(name)]

    def _referred(self, name: str, v: Value, other: Value, chain: list[str], mode: Mode) -> Column:
        flat = isinstance(other.kind, T.ArrayType)
        if chain:
            if flat or set(chain) - set(COLUMN_MODIFIERS):
                raise CompileError(f"{'|'.join(chain)} of another field is not supported")
            found = [F.encode(other.text, "UTF-8")]
            for m in chain:
                found = [y for x in found for y in COLUMN_MODIFIERS[m](x)]
            # bytes that are no text match nothing
            texts = [F.try_validate_utf8(x.cast("string")) for x in found]
            return any_of([t.isNotNull() & compare_fields(name, v, Value(t, T.StringType()), mode) for t in texts])
        if flat:
            return F.exists(other.col, lambda x: true_or_false(compare_fields(name, v, Value(x, other.kind.elementType), mode)))
        return other.col.isNotNull() & compare_fields(name, v, other, mode)

    def _on(self, v: Value, flat: bool, parts_of: list[str], test: Callable[[Value], Column]) -> Column:
        """A test on a value or, for mapped arrays, on any element; a missing array is one missing value."""
        if flat:
            element = v.kind.elementType
            nothing = self._on(Value(F.lit(None).cast(element), element), False, parts_of, test)
            return F.when(v.col.isNull(), nothing).otherwise(F.exists(v.col, lambda x: true_or_false(self._on(Value(x, element), False, parts_of, test))))
        for m in parts_of[:1]:
            part = EVENT_MODIFIERS[m](local_time(v)).cast("bigint")
            return part.isNotNull() & true_or_false(test(Value(part, T.LongType())))
        return test(v)

    def keywords(self, words: tuple[str, ...]) -> Column:
        """Any keyword in any top-level value."""
        cased = self.case_sensitive

        def found(text: Column) -> Column:
            parts = []
            for w in words:
                if "*" in w or "?" in w:
                    parts.append(text.rlike(patterns.keyword_regex(w, cased)))
                else:
                    parts.append(text.contains(w) if cased else F.lower(text).contains(w.lower()))
            return any_of(parts)

        f = self.fields
        if f.mode == "typed":
            return any_of([found(go_text(column(s.name), s.dataType)) for s in f.schema.fields])
        kind = f.schema[f.source].dataType.valueType if f.mode == "map" else T.StringType()
        return F.exists(F.map_values(f._map()), lambda x: true_or_false(found(go_text(x, kind, "<nil>"))))

    def condition(self, node: object, searches: dict[str, Column]) -> Column:
        """The column of a search expression over compiled searches."""
        if isinstance(node, c.And):
            return all_of([self.condition(n, searches) for n in node.nodes])
        if isinstance(node, c.Or):
            return any_of([self.condition(n, searches) for n in node.nodes])
        if isinstance(node, c.Not):
            return ~true_or_false(self.condition(node.node, searches))
        if isinstance(node, c.Quantified):
            some = [searches[n] for n in c.search_names(node, list(searches)) if n in searches]
            if node.kind == "name":
                return some[0] if some else F.lit(False)
            return all_of(some) if node.every else any_of(some)
        return searches.get(node.name, F.lit(False))

    def searches(self, rule: Rule) -> dict[str, Column]:
        return {name: self.search(s) for name, s in rule.detection.searches.items()}
