"""The condition language: tokens, a recursive-descent parser, the tree, and its text."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<quant>(?i:1 of them|all of them|1 of|all of))|(?P<glob>[A-Za-z0-9_*?]*[*?][A-Za-z0-9_*?]*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<paren>[()])|(?P<op>!=|<=|>=|=|<|>)|(?P<number>0|[1-9][0-9]*)|(?P<pipe>\|)|(?P<comma>,)|(?P<space>\s+)"
)
FUNCTIONS = ("count", "min", "max", "avg", "sum")


class ConditionError(ValueError):
    """A condition that doesn't parse."""


@dataclass(frozen=True)
class And:
    nodes: tuple


@dataclass(frozen=True)
class Or:
    nodes: tuple


@dataclass(frozen=True)
class Not:
    node: object


@dataclass(frozen=True)
class Name:
    """A search by name."""

    name: str


@dataclass(frozen=True)
class Quantified:
    """`1 of` or `all of` a name, a pattern or them."""

    every: bool
    target: str
    kind: str  # "name", "pattern" or "them"


@dataclass(frozen=True)
class Near:
    node: object


@dataclass(frozen=True)
class Aggregate:
    """func(field) by group op threshold."""

    func: str
    field: str
    group: tuple[str, ...]
    op: str
    threshold: int


@dataclass(frozen=True)
class Condition:
    search: object
    aggregation: object = None
    line: int = 0
    column: int = 0

    def __str__(self) -> str:
        return text_of(self.search, 0) + (f" | {_aggregation_text(self.aggregation)}" if self.aggregation else "")


def text_of(node: object, level: int = 0) -> str:
    """The text of a search tree; level: 0 in or, 1 in and, 2 in not."""
    if isinstance(node, Or):
        text = " or ".join(text_of(n, 1) for n in node.nodes)
        return f"({text})" if level > 0 else text
    if isinstance(node, And):
        text = " and ".join(text_of(n, 2) for n in node.nodes)
        return f"({text})" if level > 1 else text
    if isinstance(node, Not):
        return "not " + text_of(node.node, 2)
    if isinstance(node, Quantified):
        return f"{'all' if node.every else '1'} of {node.target}"
    return node.name


def _aggregation_text(a: object) -> str:
    if isinstance(a, Near):
        return "near " + text_of(a.node)
    by = f" by {', '.join(a.group)}" if a.group else ""
    return f"{a.func}({a.field}){by} {a.op} {a.threshold}"


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.tokens = text, 0, []
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ConditionError(f"unexpected {text[place]!r} at {place + 1} in {text!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            place = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str | None:
        k, v = self.peek()
        if k == kind and (value is None or v == value):
            self.at += 1
            return v
        return None

    def need(self, kind: str, value: str | None = None) -> str:
        got = self.take(kind, value)
        if got is None:
            raise ConditionError(f"expected {value or kind}, found {self.peek()[1] or 'the end'!r} in {self.text!r}")
        return got

    def disjunction(self) -> object:
        nodes = [self.conjunction()]
        while self.take("name", "or"):
            nodes.append(self.conjunction())
        return nodes[0] if len(nodes) == 1 else Or(tuple(nodes))

    def conjunction(self) -> object:
        nodes = [self.term()]
        while self.take("name", "and"):
            nodes.append(self.term())
        return nodes[0] if len(nodes) == 1 else And(tuple(nodes))

    def term(self) -> object:
        if self.take("name", "not"):
            return Not(self.term())
        kind, value = self.peek()
        if kind == "quant":
            self.at += 1
            every = value.lower().startswith("all")
            if value.lower().endswith("them"):
                return Quantified(every, "them", "them")
            pattern = self.take("glob")
            return Quantified(every, pattern or self.need("name"), "pattern" if pattern else "name")
        if self.take("paren", "("):
            inner = self.disjunction()
            self.need("paren", ")")
            return inner
        return Name(self.need("name"))

    def aggregation(self) -> object:
        if self.take("name", "near"):
            return Near(self.disjunction())
        func = self.need("name")
        if func not in FUNCTIONS:
            raise ConditionError(f"unknown aggregation {func!r} in {self.text!r}")
        field = ""
        if self.take("paren", "("):
            field = self.take("name") or ""
            self.need("paren", ")")
        group = []
        if self.take("name", "by"):
            group.append(self.need("name"))
            while self.take("comma"):
                group.append(self.need("name"))
        op = self.need("op")
        return Aggregate(func, field, tuple(group), op, int(self.need("number")))


def parse_condition(text: str, line: int = 0, column: int = 0) -> Condition:
    """Parses `search [| aggregation]`."""
    p = _Parser(text)
    search = p.disjunction()
    aggregation = p.aggregation() if p.take("pipe") else None
    if p.peek()[0] != "end":
        raise ConditionError(f"unexpected {p.peek()[1]!r} in {text!r}")
    return Condition(search, aggregation, line, column)


def glob_matches(pattern: str, name: str) -> bool:
    """Path-style glob over names: * and ? stop at /."""
    regex = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
    return re.fullmatch(regex, name, re.S) is not None


def search_names(node: object, names: list[str]) -> list[str]:
    """The searches that a tree refers to, patterns expanded over names."""
    if isinstance(node, And | Or):
        return list(dict.fromkeys(n for x in node.nodes for n in search_names(x, names)))
    if isinstance(node, Not):
        return search_names(node.node, names)
    if isinstance(node, Quantified):
        if node.kind == "name":
            return [node.target]
        return [n for n in names if node.kind == "them" or glob_matches(node.target, n)]
    return [node.name]
