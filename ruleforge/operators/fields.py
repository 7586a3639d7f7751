"""Where the values of a rule's fields are in a DataFrame: typed columns, one map, or one JSON text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleforge.functions.comparators import Value
from ruleforge.rules.model import Config

_STEP = re.compile(r"""\.([A-Za-z_][\w-]*)|\[['"]([^'"]+)['"]\]|\[(\d+)\]|(\[\*\]|\.\*)""")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Fields:
    """Resolves field names.

    mode: "typed" (a column a field), "map" (the column `source` holds text by field) or "json" (`source` is a JSON
    object). absent: in map mode, "null", or "empty" if a missing key reads as an empty text.
    """

    schema: T.StructType
    mode: str = "typed"
    source: str = ""
    absent: str = "null"
    mappings: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, mode: str = "typed", source: str = "", absent: str = "null", configs: list[Config] | None = None) -> Fields:
        merged: dict[str, list[str]] = {}
        for config in configs or []:
            for name, targets in config.field_mappings.items():
                merged.setdefault(name, []).extend(targets)
        return cls(df.schema, mode, source, absent, merged)

    def _map(self) -> Column:
        c = column(self.source)
        return c if self.mode == "map" else F.from_json(c, "map<string,string>")

    def direct(self, name: str) -> Value:
        """The value under a name, null if there is none."""
        if self.mode == "typed":
            if name in self.schema.names:
                return Value(column(name), self.schema[name].dataType)
            return Value(F.lit(None).cast("string"), T.StringType())
        kind = self.schema[self.source].dataType.valueType if self.mode == "map" else T.StringType()
        got = F.try_element_at(self._map(), F.lit(name))
        if self.mode == "map" and self.absent == "empty":
            got = F.coalesce(got, F.lit("").cast(kind))
        return Value(got, kind)

    def present(self, name: str) -> Column:
        """Whether the key is there; in typed mode, whether it is not null."""
        if self.mapped(name):
            hits = [v.col.isNotNull() if flat or self.mode == "typed" or target[:2] in ("$.", "$[") else F.coalesce(F.map_contains_key(self._map(), F.lit(target)), F.lit(False)) for target in self.mappings[name] for v, flat in [self.target(target)]]
            out = F.lit(False)
            for h in hits:
                out = out | h
            return out
        if self.mode == "typed":
            return self.direct(name).col.isNotNull()
        return F.coalesce(F.map_contains_key(self._map(), F.lit(name)), F.lit(False))

    def mapped(self, name: str) -> bool:
        return name in self.mappings

    def target(self, target: str) -> tuple[Value, bool]:
        """The value of a mapping's target, and whether it is an array whose elements count."""
        value = self.path(target) if target[:2] in ("$.", "$[") else self.direct(target)
        return value, isinstance(value.kind, T.ArrayType)

    def values(self, name: str) -> list[tuple[Value, bool]]:
        """All values of a field, each with whether its elements count one by one (mapped arrays)."""
        if self.mapped(name):
            return [self.target(t) for t in self.mappings[name]]
        return [(self.direct(name), False)]

    def path(self, path: str) -> Value:
        """The value at a JSON path: keys, indexes and [*]; a top-level text is read as JSON."""
        steps = []
        at = 1
        while at < len(path):
            m = _STEP.match(path, at)
            if not m:
                raise ValueError(f"unsupported path {path!r}")
            steps.append(("all",) if m[4] else ("at", int(m[3])) if m[3] else ("key", m[1] or m[2]))
            at = m.end()
        if not steps or steps[0][0] != "key":
            raise ValueError(f"unsupported path {path!r}")
        value = self.direct(steps[0][1])
        rest = steps[1:]
        if not rest:
            return value
        if isinstance(value.kind, T.StringType | T.BinaryType):
            return self._json(value, rest)
        return _walk(value, rest)

    def _json(self, value: Value, steps: list[tuple]) -> Value:
        """Into a JSON text, through a schema that the path itself implies."""
        stars = [i for i, s in enumerate(steps) if s[0] == "all"]
        doc = F.try_parse_json(value.text)
        if not stars:
            path = "$" + "".join(f"[{s[1]}]" if s[0] == "at" else f'["{s[1]}"]' for s in steps)
            many = F.try_variant_get(doc, path, "array<string>")
            one = F.try_variant_get(doc, path, "string")
            # a list at the end of a path counts element by element; one value is a list of one
            return Value(F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(doc, path, "variant")).startswith("ARRAY"), F.lit(False)), many).otherwise(F.when(one.isNotNull(), F.array(one))), T.ArrayType(T.StringType()))
        kind: T.DataType = T.StringType()
        for s in reversed(steps):
            kind = T.ArrayType(kind) if s[0] in ("all", "at") else T.StructType([T.StructField(s[1], kind)])
        return _walk(Value(F.from_json(value.text, kind), kind), steps)


def _walk(value: Value, steps: list[tuple]) -> Value:
    """Into nested columns; [*], and a key below an array, go over all elements."""
    c, kind = value.col, value.kind
    for i, step in enumerate(steps):
        missing = Value(F.lit(None).cast("string"), T.StringType())
        if isinstance(kind, T.ArrayType):
            if step[0] == "at":
                c, kind = F.get(c, F.lit(step[1])), kind.elementType
                continue
            rest = steps[i + 1 :] if step[0] == "all" else steps[i:]
            if not rest:
                return Value(c, kind)
            inner = _walk(Value(F.lit(None).cast(kind.elementType), kind.elementType), rest).kind
            element = kind.elementType
            got = F.transform(c, lambda x: _walk(Value(x, element), rest).col)
            if isinstance(inner, T.ArrayType):
                return Value(F.flatten(F.transform(got, lambda x: F.coalesce(x, F.array().cast(inner)))), inner)
            return Value(F.filter(got, lambda x: x.isNotNull()), T.ArrayType(inner))
        if step[0] != "key":
            return missing
        if isinstance(kind, T.StructType):
            if step[1] not in kind.names:
                return missing
            c, kind = c.getField(step[1]), kind[step[1]].dataType
        elif isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(step[1])), kind.valueType
        else:
            return missing
    return Value(c, kind)
