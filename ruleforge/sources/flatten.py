"""Nested event log records as flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of a log record that keep their names.
_SYSTEM = ("Channel", "Computer", "Level", "Task", "Opcode", "Version", "EventRecordID", "Keywords")


def trimmed(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def _leaves(c: Column, kind: T.DataType, name: str, out: dict[str, Column]) -> None:
    """The leaves of a struct by their own names; later ones take the place of earlier ones."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _leaves(c.getField(f.name), f.dataType, f.name, out)
    else:
        out.pop(name, None)
        out[name] = trimmed(c) if isinstance(kind, T.StringType) else c


def flatten_events(df: DataFrame, raw: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """Columns for the known parts of Event.System, then the leaves of EventData and UserData.

    raw: a struct column with Event (or Event's own fields). keep: further columns that stay.
    """
    root, kind = F.col(raw), df.schema[raw].dataType
    if "Event" in kind.names:
        root, kind = root.getField("Event"), kind["Event"].dataType
    out: dict[str, Column] = {}
    if "System" in kind.names:
        system, parts = root.getField("System"), kind["System"].dataType

        def inner(name: str, *steps: str) -> Column | None:
            c, t = system, parts
            for s in (name, *steps):
                if not isinstance(t, T.StructType) or s not in t.names:
                    return None
                c, t = c.getField(s), t[s].dataType
            return c

        event_id = inner("EventID", "Value") if isinstance(parts["EventID"].dataType if "EventID" in parts.names else None, T.StructType) else inner("EventID")
        found = {"Provider_Name": inner("Provider", "Name"), "EventID": event_id} | {n: inner(n) for n in _SYSTEM} | {"TimeCreated": inner("TimeCreated", "SystemTime"), "ProcessID": inner("Execution", "ProcessID"), "ThreadID": inner("Execution", "ThreadID")}
        out |= {k: v for k, v in found.items() if v is not None}
    for part in ("EventData", "UserData"):
        if part in kind.names:
            _leaves(root.getField(part), kind[part].dataType, part, out)
    return df.select(*(keep or []), *[c.alias(n) for n, c in out.items() if n not in (keep or [])])


def event_time(df: DataFrame) -> Column:
    """TimeCreated as a time if it is a number of seconds, else null."""
    if "TimeCreated" in df.columns and isinstance(df.schema["TimeCreated"].dataType, T.DoubleType | T.FloatType):
        return F.timestamp_micros((F.col("TimeCreated") * 1_000_000).try_cast("bigint"))
    return F.lit(None).cast("timestamp")
