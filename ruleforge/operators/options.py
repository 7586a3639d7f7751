"""Settings of an evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleforge.functions.literals import Expander, expander_of
from ruleforge.rules.model import Config

from .fields import Fields, column
from .search import Compiler

HOUR = 3_600_000_000


@dataclass
class Options:
    """mode, source, absent: see Fields. configs apply in order; expander: of placeholders, else those of the configs.

    window_mode: "estimate" (two buckets) or "exact" for count, sum and avg. window: where a rule has no timeframe.
    time, seq: the columns that order events (a timestamp, or microseconds; a number that parts equal times).
    aggregators: own implementations by function name, see windows.add_aggregate.
    """

    mode: str = "typed"
    source: str = ""
    absent: str = "null"
    configs: list[Config] = field(default_factory=list)
    expander: Expander | dict | None = None
    case_sensitive: bool = False
    lazy: bool = False
    window_mode: str = "estimate"
    window: int = HOUR
    time: str = "ts"
    seq: str | None = None
    aggregators: dict[str, Callable] = field(default_factory=dict)

    def compiler(self, df: DataFrame) -> Compiler:
        expander = self.expander
        if expander is None and (known := {k: v for c in self.configs for k, v in c.placeholders.items()}):
            expander = known
        return Compiler(Fields.of(df, self.mode, self.source, self.absent, self.configs), expander_of(expander), self.case_sensitive)

    def micros(self, df: DataFrame) -> Column:
        """The event time in microseconds since 1970; where the frame has none, the current time."""
        if self.time not in df.columns:
            return F.unix_micros(F.current_timestamp())
        kind = df.schema[self.time].dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz", "date"):
            # read as UTC whatever the session's zone
            c = column(self.time)
            return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())) if kind == "timestamp_ntz" else F.unix_micros(c.cast("timestamp"))
        if kind in ("double", "float"):
            return (column(self.time).cast("double") * 1_000_000).cast("bigint")
        return column(self.time).cast("bigint")

    def order(self, df: DataFrame) -> Column:
        return column(self.seq).cast("bigint") if self.seq else F.lit(0).cast("bigint")
