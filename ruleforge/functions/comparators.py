"""Comparisons of one event value with one rule value, as boolean columns in which null means no match."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleforge.rules.reader import number

from . import patterns
from .gotext import go_text


@dataclass(frozen=True)
class Value:
    """An event value: its column and type."""

    col: Column
    kind: T.DataType

    @property
    def text(self) -> Column:
        return go_text(self.col, self.kind)


@dataclass(frozen=True)
class Mode:
    """How to compare: whether case counts, regex flags."""

    cased: bool = False
    flags: str = ""


def _same_case(text: str) -> bool:
    return text.lower() == text.upper()


def _equal(v: Value, text: str, mode: Mode) -> Column:
    """Anchored equality with wildcards; `null` is what a missing value has for text."""
    nothing = v.col.isNull() if text == "null" else None
    if patterns.has_wildcard(text):
        found = v.text.rlike(patterns.wildcard_regex(text, True, True, mode.cased))
        return found
    plain = patterns.literal(text)
    if isinstance(v.kind, T.IntegralType) and text.lstrip("-").isdigit() and str(int(text)) == text and abs(int(text)) < 1 << 31:
        return v.col == int(text)  # reaches the scan
    if mode.cased or _same_case(plain):
        found = v.text == plain
    elif plain.isascii():
        found = F.lower(v.text) == plain.lower()
    else:
        found = v.text.rlike("(?isu)\\A" + patterns.java_quote(plain) + "\\z")
    return found if nothing is None else nothing | F.coalesce(found, F.lit(False))


def _affix(start: bool, end: bool) -> Callable[[Value, str, Mode], Column]:
    def compare(v: Value, text: str, mode: Mode) -> Column:
        if patterns.has_wildcard(text):
            return v.text.rlike(patterns.wildcard_regex(text, start, end, mode.cased))
        plain = patterns.literal(text)
        column = v.text if mode.cased or _same_case(plain) else F.lower(v.text)
        plain = plain if mode.cased else plain.lower()
        return column.startswith(plain) if start else column.endswith(plain) if end else column.contains(plain)

    return compare


def _regex(v: Value, text: str, mode: Mode) -> Column:
    try:
        java = patterns.re2_to_java(text, mode.flags)
    except patterns.InvalidPattern:
        return F.lit(False)
    found = v.text.rlike(java)
    need = patterns.required_text(text, mode.flags)
    return v.text.contains(need) & found if len(need) > 2 and need != text else found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def ip_number(text: Column) -> Column:
    """An IPv4 address, also mapped into IPv6, as a number; null for anything else."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

    def number_of(parts: Column) -> Column:
        return sum((F.get(parts, F.lit(i)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))

    bare = F.regexp_replace(text, r"(?i)\A::ffff:(?=\d+\.)", "")
    return let(bare, lambda x: F.when(x.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), let(F.split(x, r"\."), number_of)))


def _cidr(v: Value, text: str, mode: Mode) -> Column:
    if "/" not in text:
        return F.lit(False)
    try:
        net = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        low = int(net.network_address)
        return let(ip_number(v.text), lambda x: x.between(low, low + net.num_addresses - 1))

    low, high = (f"{int(x):032x}" for x in (net.network_address, net.broadcast_address))
    return let(ip6_figures(v.text), lambda x: x.between(low, high) & ~x.startswith("0" * 20 + "ffff"))


def ip6_figures(text: Column) -> Column:
    """An IPv6 address as 32 hexadecimal figures; null for anything else."""
    group = r"[0-9a-f]{1,4}"
    form = rf"\A(?:{group}(?::{group})*)?(?:::(?:{group}(?::{group})*)?)?\z"

    def two_groups(x: Column) -> Column:
        """The last two groups may be written as IPv4."""
        tail = F.regexp_extract(x, r":(\d+\.\d+\.\d+\.\d+)\z", 1)
        return let(F.lpad(F.hex(ip_number(tail)), 8, "0"), lambda four: F.concat(F.regexp_extract(x, r"(?s)\A(.*:)", 1), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)))

    def wide(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda x: F.lpad(x, 4, "0")), "")

    def joined(left: Column, right: Column, short: Column) -> Column:
        groups = F.size(left) + F.size(right)
        return F.when(F.when(short, groups <= 7).otherwise(groups == 8), F.concat(wide(left), F.repeat(F.lit("0000"), F.lit(8) - groups), wide(right)))

    def of_halves(halves: Column) -> Column:
        left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "") for i in (0, 1))
        return let(left, lambda a: let(right, lambda b: joined(a, b, F.size(halves) == 2)))

    plain = let(text, lambda x: F.lower(F.when(x.rlike(r":\d+\.\d+\.\d+\.\d+\z"), two_groups(x)).otherwise(x)))
    return let(plain, lambda x: F.when(x.rlike(form), let(F.split(x, "::"), of_halves)))


def numeric(v: Value) -> tuple[Column | None, Column]:
    """A value as (exact whole number or None, double); null where it is no number."""
    if isinstance(v.kind, T.IntegralType):
        return v.col.cast("decimal(38,0)"), v.col.cast("double")
    if isinstance(v.kind, T.NumericType):
        return None, v.col.cast("double")
    if not isinstance(v.kind, T.StringType | T.BinaryType):
        return None, F.lit(None).cast("double")
    bare = F.replace(v.text, F.lit("_"), F.lit(""))
    sign = F.when(bare.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    based = F.when(bare.rlike(r"(?i)\A[-+]?0x[0-9a-f]+\z"), F.conv(F.regexp_replace(bare, r"(?i)\A[-+]?0x", ""), 16, 10)).when(bare.rlike(r"(?i)\A[-+]?0o?[0-7]+\z") & ~bare.rlike(r"\A[-+]?0\z"), F.conv(F.regexp_replace(bare, r"(?i)\A[-+]?0o?", ""), 8, 10)).when(bare.rlike(r"(?i)\A[-+]?0b[01]+\z"), F.conv(F.regexp_replace(bare, r"(?i)\A[-+]?0b", ""), 2, 10))
    exact = F.coalesce(based.try_cast("decimal(38,0)") * sign, F.when(bare.rlike(r"\A[-+]?[0-9]{1,38}\z"), bare.try_cast("decimal(38,0)")))
    fractional = F.when(bare.rlike(r"\A[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\z"), bare.try_cast("double")).when(bare.rlike(r"\A\+?\.(?:inf|Inf|INF)\z"), F.lit(float("inf"))).when(bare.rlike(r"\A-\.(?:inf|Inf|INF)\z"), F.lit(float("-inf")))
    return exact, F.coalesce(exact.cast("double"), fractional)


def _ordered(op: str) -> Callable[[Value, str, Mode], Column]:
    def test(a: Column, b: object) -> Column:
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]

    def compare(v: Value, text: str, mode: Mode) -> Column:
        try:
            wanted = number(text)
        except ValueError:
            return F.lit(False)
        if wanted != wanted:
            return F.lit(False)
        if isinstance(wanted, int) and isinstance(v.kind, T.IntegralType) and abs(wanted) < 1 << 63:
            return test(v.col, wanted)  # reaches the scan
        if isinstance(v.kind, T.DoubleType):
            return test(v.col, float(wanted)) & ~F.isnan(v.col)
        exact, floating = numeric(v)
        if isinstance(wanted, int) and exact is not None and len(str(abs(wanted))) <= 38:
            return F.coalesce(test(exact, F.lit(str(wanted)).cast("decimal(38,0)")), test(floating, float(wanted)))
        return test(floating, float(wanted)) & ~F.isnan(floating)

    return compare


#: name -> function of an event value, a rule value's text and the mode. More can be registered.
COMPARATORS: dict[str, Callable[[Value, str, Mode], Column]] = {
    "": _equal, "contains": _affix(False, False), "startswith": _affix(True, False), "endswith": _affix(False, True),
    "re": _regex, "cidr": _cidr, "gt": _ordered("gt"), "gte": _ordered("gte"), "lt": _ordered("lt"), "lte": _ordered("lte"),
}


def compare_fields(name: str, v: Value, other: Value, mode: Mode) -> Column:
    """A comparison with another field's value, taken as it is."""
    a, b = v.text, other.text
    if name in ("gt", "gte", "lt", "lte"):
        x, y = numeric(v), numeric(other)
        ops = {"gt": lambda p, q: p > q, "gte": lambda p, q: p >= q, "lt": lambda p, q: p < q, "lte": lambda p, q: p <= q}[name]
        return ops(x[1], y[1]) if x[0] is None or y[0] is None else F.coalesce(ops(x[0], y[0]), ops(x[1], y[1]))
    if name == "cidr":

        @F.pandas_udf("boolean")
        def inside(ips: pd.Series, nets: pd.Series) -> pd.Series:
            def one(ip: str | None, net: str | None) -> bool:
                try:
                    return "/" in net and ipaddress.ip_address(ip) in ipaddress.ip_network(net, strict=False)
                except (ValueError, TypeError):
                    return False

            return pd.Series([one(i, n) for i, n in zip(ips, nets, strict=True)], dtype=bool)

        return inside(a, b)
    if name == "re":
        return a.contains(b)
    if not mode.cased:
        a, b = F.lower(a), F.lower(b)
    return {"": a == b, "contains": a.contains(b), "startswith": a.startswith(b), "endswith": a.endswith(b)}[name]


_LAYOUT = r"\A(\d{4}-\d{2}-\d{2})(?:([T ])(\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[-+]\d{2}:\d{2})?)?\z"


def local_time(v: Value) -> Column:
    """A value as a time of its own offset; whole or broken seconds since 1970 count as UTC. Null if it is none."""
    if isinstance(v.kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return v.col.cast("timestamp_ntz")
    if isinstance(v.kind, T.NumericType):
        return F.timestamp_micros((v.col.cast("double") * 1_000_000).try_cast("bigint")).cast("timestamp_ntz") if not isinstance(v.kind, T.IntegralType) else F.timestamp_seconds(v.col.cast("bigint")).cast("timestamp_ntz")
    text = v.text
    gap, zone = F.regexp_extract(text, _LAYOUT, 2), F.regexp_extract(text, _LAYOUT, 5)
    fits = text.rlike(_LAYOUT) & ((gap != " ") | (zone == ""))
    clock = F.coalesce(F.nullif(F.regexp_extract(text, _LAYOUT, 3), F.lit("")), F.lit("00:00:00"))
    return F.when(fits, F.try_to_timestamp(F.concat(F.regexp_extract(text, _LAYOUT, 1), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")


#: name -> function from a time to a number.
EVENT_MODIFIERS: dict[str, Callable[[Column], Column]] = {"minute": F.minute, "hour": F.hour, "day": F.dayofmonth, "week": F.weekofyear, "month": F.month, "year": F.year}


def register_comparator(name: str, compare: Callable[[Value, str, Mode], Column]) -> None:
    """Adds a comparator: whether an event value fits the text of a rule's value, null or false for no."""
    COMPARATORS[name] = compare


def register_event_modifier(name: str, part: Callable[[Column], Column]) -> None:
    """Adds an event modifier: a number from a local time."""
    EVENT_MODIFIERS[name] = part
