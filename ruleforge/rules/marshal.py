"""Rules back to YAML; what parse_rule reads of it equals the rule."""

from __future__ import annotations

import yaml

from . import model as m
from .timespan import format_timespan


class _Dumper(yaml.SafeDumper):
    """Keeps the order of keys."""

    def ignore_aliases(self, data) -> bool:
        return True


class _Pairs(list):
    """A map whose keys may repeat."""


def _pairs(dumper: yaml.Dumper, data: _Pairs) -> yaml.Node:
    return yaml.MappingNode("tag:yaml.org,2002:map", [(dumper.represent_data(k), dumper.represent_data(v)) for k, v in data])


_Dumper.add_representer(_Pairs, _pairs)


def _alternative(fields: tuple[m.FieldMatcher, ...]) -> _Pairs:
    return _Pairs(("|".join((f.field, *f.modifiers)), f.values[0] if len(f.values) == 1 else list(f.values)) for f in fields)


def _search(s: m.Search):
    if s.keywords:
        return list(s.keywords)
    found = [_alternative(a) for a in s.matchers]
    return found[0] if len(found) == 1 else found


def _logsource(s: m.Logsource) -> dict:
    return {k: v for k, v in (("category", s.category), ("product", s.product), ("service", s.service), ("definition", s.definition)) if v} | s.extra


def marshal_rule(rule: m.Rule) -> str:
    """The YAML text of a rule."""
    out: dict = {k: v for k, v in (("title", rule.title), ("id", rule.id), ("name", rule.name), ("related", list(rule.related)), ("status", rule.status), ("description", rule.description), ("author", rule.author), ("level", rule.level), ("references", list(rule.references)), ("tags", list(rule.tags))) if v}
    if _logsource(rule.logsource):
        out["logsource"] = _logsource(rule.logsource)
    d = rule.detection
    if d.searches or d.conditions:
        out["detection"] = {k: _search(s) for k, s in d.searches.items()}
        if d.timeframe:
            out["detection"]["timeframe"] = format_timespan(d.timeframe) if d.timeframe > 0 and d.timeframe % 1_000_000 == 0 else str(d.timeframe * 1000)
        texts = [str(c) for c in d.conditions]
        out["detection"]["condition"] = texts[0] if len(texts) == 1 else texts
    if c := rule.correlation:
        terms = {k: int(v) if v == int(v) else v for k, v in c.condition}
        out["correlation"] = {k: v for k, v in (("type", c.type), ("rules", list(c.rules)), ("group-by", list(c.group_by)), ("timespan", format_timespan(c.timespan) if c.timespan else ""), ("aliases", c.aliases), ("condition", terms | ({"field": c.condition_field} if c.condition_field else {})), ("generate", c.generate)) if v}
    return yaml.dump(out | rule.extra, Dumper=_Dumper, sort_keys=False, allow_unicode=True)
