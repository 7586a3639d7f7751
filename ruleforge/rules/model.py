"""Rules, correlations and configurations as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from .condition import Condition


@dataclass(frozen=True)
class FieldMatcher:
    """field|modifier|...: values. Values are as YAML has them; line and column of the key."""

    field: str
    modifiers: tuple[str, ...]
    values: tuple
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class Search:
    """Keywords, or alternatives of field matchers that all hold."""

    keywords: tuple[str, ...] = ()
    matchers: tuple[tuple[FieldMatcher, ...], ...] = ()
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class Detection:
    searches: dict[str, Search] = field(default_factory=dict)
    conditions: tuple[Condition, ...] = ()
    timeframe: int = 0  # microseconds; 0 or less: the default of the operator


@dataclass(frozen=True)
class Logsource:
    category: str = ""
    product: str = ""
    service: str = ""
    definition: str = ""
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Correlation:
    type: str
    rules: tuple[str, ...]
    group_by: tuple[str, ...] = ()
    timespan: int = 0
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    condition: tuple[tuple[str, float], ...] = ()
    condition_field: str = ""
    generate: bool = False


@dataclass(frozen=True)
class Rule:
    title: str = ""
    id: str = ""
    name: str = ""
    related: tuple = ()
    status: str = ""
    description: str = ""
    author: str = ""
    level: str = ""
    references: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    logsource: Logsource = Logsource()
    detection: Detection = Detection()
    correlation: Correlation | None = None
    extra: dict = field(default_factory=dict)

    @property
    def key(self) -> str:
        """What state and results of the rule go by: id, else name, else title."""
        return self.id or self.name or self.title


@dataclass(frozen=True)
class LogsourceMapping:
    name: str
    logsource: Logsource
    index: tuple[str, ...] = ()
    conditions: Search = Search()
    rewrite: Logsource = Logsource()


@dataclass(frozen=True)
class Config:
    title: str = ""
    order: int = 0
    backends: tuple[str, ...] = ()
    field_mappings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    logsources: tuple[LogsourceMapping, ...] = ()
    logsource_merging: str = ""
    default_index: str = ""
    placeholders: dict[str, tuple] = field(default_factory=dict)
