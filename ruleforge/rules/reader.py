"""YAML to rules and configurations, read at node level so that repeated keys and positions survive."""

from __future__ import annotations

import re

import yaml

from . import model as m
from .condition import Condition, parse_condition
from .timespan import parse_timeframe, parse_timespan


class RuleError(ValueError):
    """A document that is no valid rule or configuration."""


class _Loader(yaml.SafeLoader):
    """YAML 1.2 scalars: yes/no stay texts, no sexagesimals; dates are kept apart as Stamp."""


class Stamp(str):
    """An unquoted date or time, which is no value for a matcher."""


_Loader.yaml_implicit_resolvers = {}
for tag, pattern, firsts in (
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("tag:yaml.org,2002:int", r"^[-+]?(?:0b[01_]+|0o?[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)$", list("-+0123456789")),
    ("tag:yaml.org,2002:float", r"^[-+]?(?:\.[0-9]+|[0-9][0-9_]*(?:\.[0-9_]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", list("-+0123456789.")),
    ("stamp", r"^\d{4}-\d\d?-\d\d?(?:(?:[Tt]|\s+)\d\d?:\d\d:\d\d(?:\.\d*)?\s*(?:Z|[-+]\d\d?(?::?\d\d)?)?)?$", list("0123456789")),
):
    _Loader.add_implicit_resolver(tag, re.compile(pattern), firsts)


def number(text: str) -> int | float:
    """A YAML number; ValueError if it is none."""
    t = text.replace("_", "")
    sign, body = (-1, t[1:]) if t[:1] == "-" else (1, t[1:] if t[:1] == "+" else t)
    low = body.lower()
    if low == ".inf":
        return sign * float("inf")
    if low == ".nan":
        return float("nan")
    for prefix, base in (("0x", 16), ("0b", 2), ("0o", 8)):
        if low.startswith(prefix):
            return sign * int(body[2:], base)
    if re.fullmatch(r"0[0-7]+", body):
        return sign * int(body, 8)
    if re.fullmatch(r"[0-9]+", body):
        return sign * int(body)
    if re.fullmatch(r"(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?", body):
        return sign * float(body)
    raise ValueError(f"not a number: {text!r}")


def _scalar(node: yaml.ScalarNode):
    kind = node.tag.rpartition(":")[2]
    if kind == "null":
        return None
    if kind == "bool":
        return node.value.lower() == "true"
    if kind in ("int", "float"):
        try:
            return number(node.value)
        except ValueError:
            return node.value
    return Stamp(node.value) if kind == "stamp" else node.value


def plain(node: yaml.Node | None):
    """Any node as Python data; the last of repeated keys wins."""
    if node is None:
        return None
    if isinstance(node, yaml.ScalarNode):
        return _scalar(node)
    if isinstance(node, yaml.SequenceNode):
        return [plain(n) for n in node.value]
    return {str(plain(k)): plain(v) for k, v in node.value}


def _compose(text: str | bytes) -> yaml.Node | None:
    try:
        return yaml.compose(text, Loader=_Loader)
    except yaml.YAMLError as e:
        raise RuleError(f"not YAML: {e}") from e


def _text(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _texts(value) -> tuple[str, ...]:
    return () if value is None else tuple(map(_text, value)) if isinstance(value, list) else (_text(value),)


def _mark(node: yaml.Node) -> tuple[int, int]:
    return node.start_mark.line + 1, node.start_mark.column + 1


def _matcher(key: yaml.Node, value: yaml.Node) -> m.FieldMatcher:
    name, *modifiers = key.value.split("|")
    if isinstance(value, yaml.SequenceNode):
        values = tuple(plain(n) for n in value.value)
    else:
        values = (plain(value),)
    return m.FieldMatcher(name, tuple(modifiers), values, *_mark(key))


def _alternative(node: yaml.Node) -> tuple[m.FieldMatcher, ...]:
    if not isinstance(node, yaml.MappingNode):
        raise RuleError(f"expected a map at line {_mark(node)[0]}")
    return tuple(_matcher(k, v) for k, v in node.value)


def read_search(node: yaml.Node) -> m.Search:
    """A map, a list of maps, or a list of keywords, told apart by the first element."""
    if isinstance(node, yaml.MappingNode):
        return m.Search((), (_alternative(node),), *_mark(node))
    if isinstance(node, yaml.SequenceNode) and node.value:
        if isinstance(node.value[0], yaml.ScalarNode):
            if not all(isinstance(n, yaml.ScalarNode) for n in node.value):
                raise RuleError(f"keywords and maps are mixed at line {_mark(node)[0]}")
            return m.Search(tuple(n.value for n in node.value), (), *_mark(node))
        return m.Search((), tuple(_alternative(n) for n in node.value), *_mark(node))
    raise RuleError(f"a search is a map or a list at line {_mark(node)[0]}")


def _conditions(node: yaml.Node) -> tuple[Condition, ...]:
    nodes = node.value if isinstance(node, yaml.SequenceNode) else [node]
    if not all(isinstance(n, yaml.ScalarNode) for n in nodes):
        raise RuleError("a condition is a text or a list of texts")
    return tuple(parse_condition(n.value, *_mark(n)) for n in nodes)


def _detection(node: yaml.Node) -> m.Detection:
    if not isinstance(node, yaml.MappingNode):
        raise RuleError("detection is no map")
    searches, conditions, timeframe = {}, (), 0
    for k, v in node.value:
        if k.value == "condition":
            conditions = _conditions(v)
        elif k.value == "timeframe":
            timeframe = parse_timeframe(str(v.value))
        else:
            searches[k.value] = read_search(v)
    return m.Detection(searches, conditions, timeframe)


def _logsource(data: dict | None) -> m.Logsource:
    known = ("category", "product", "service", "definition")
    data = data or {}
    return m.Logsource(*(_text(data.get(k)) for k in known), {k: v for k, v in data.items() if k not in known})


OPERATORS = ("gt", "gte", "lt", "lte", "eq", "neq")


def _correlation(data: dict) -> m.Correlation:
    terms, name = [], ""
    for k, v in (data.get("condition") or {}).items():
        if k == "field":
            name = _text(v)
        elif k in OPERATORS and isinstance(v, int | float) and not isinstance(v, bool):
            terms.append((k, float(v)))
        else:
            raise RuleError(f"unknown correlation condition {k!r}")
    span = data.get("timespan")
    return m.Correlation(
        _text(data.get("type")), _texts(data.get("rules")), _texts(data.get("group-by")), parse_timespan(_text(span)) if span is not None else 0,
        {k: {a: _text(b) for a, b in v.items()} for k, v in (data.get("aliases") or {}).items()}, tuple(terms), name, bool(data.get("generate")),
    )


_KNOWN = ("title", "id", "name", "related", "status", "description", "author", "level", "references", "tags", "logsource", "detection", "correlation")


def parse_rule(text: str | bytes) -> m.Rule:
    """One rule or correlation from YAML."""
    root = _compose(text)
    if not isinstance(root, yaml.MappingNode):
        raise RuleError("a rule is a map")
    nodes = {k.value: v for k, v in root.value}
    data = plain(root)
    try:
        detection = _detection(nodes["detection"]) if "detection" in nodes else m.Detection()
        correlation = _correlation(data["correlation"]) if isinstance(data.get("correlation"), dict) else None
    except ValueError as e:
        raise e if isinstance(e, RuleError) else RuleError(str(e)) from e
    return m.Rule(
        *(_text(data.get(k)) for k in ("title", "id", "name")), tuple(data.get("related") or ()), *(_text(data.get(k)) for k in ("status", "description", "author", "level")),
        _texts(data.get("references")), _texts(data.get("tags")), _logsource(data.get("logsource")), detection, correlation, {k: v for k, v in data.items() if k not in _KNOWN},
    )


def parse_config(text: str | bytes) -> m.Config:
    """A configuration: field mappings, logsources with indexes, conditions and rewrites, merging, placeholders."""
    root = _compose(text)
    if not isinstance(root, yaml.MappingNode):
        raise RuleError("a configuration is a map")
    data = plain(root)
    nodes = {k.value.lower(): v for k, v in root.value}
    low = {k.lower(): v for k, v in data.items()}
    merging = _text(low.get("logsourcemerging")).lower()
    if merging not in ("", "and", "or"):
        raise RuleError(f"unknown logsourcemerging {merging!r}")
    mapped = low.get("fieldmappings") or {}
    sources = []
    for k, v in nodes["logsources"].value if isinstance(nodes.get("logsources"), yaml.MappingNode) else ():
        own, entry = {x.value: y for x, y in v.value}, plain(v)
        sources.append(m.LogsourceMapping(k.value, _logsource(entry), _texts(entry.get("index")), read_search(own["conditions"]) if "conditions" in own else m.Search(), _logsource(entry.get("rewrite"))))
    return m.Config(
        _text(low.get("title")), int(low.get("order") or 0), _texts(low.get("backends")), {k: () if isinstance(v, dict) else _texts(v) for k, v in mapped.items()},
        tuple(sources), merging, _text(low.get("defaultindex")), {k: tuple(v) if isinstance(v, list) else (v,) for k, v in (low.get("placeholders") or {}).items()},
    )


def infer_kind(text: str | bytes) -> str:
    """rule, config, unknown or invalid, by the first top-level key that tells."""
    try:
        root = _compose(text)
    except RuleError:
        return "invalid"
    if not isinstance(root, yaml.MappingNode):
        return "invalid" if root is not None else "unknown"
    for k, _ in root.value:
        if k.value in ("detection", "correlation"):
            return "rule"
        if k.value == "logsources":
            return "config"
    return "unknown"


def split_documents(text: str) -> list[str]:
    """The documents of a file, parted at lines of --- that may carry a comment."""
    parts = re.split(r"(?m)^---[ \t]*(?:#.*)?\r?$", text)
    return [p for p in parts if p.strip()]
