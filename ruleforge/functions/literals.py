"""Rule values on the driver: their text, placeholders, and value modifiers that fan out into candidates."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from decimal import Decimal
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleforge.rules.reader import Stamp

from .gotext import base64_text

# The dashes and slash that windash exchanges; for base64offset, the characters that each alignment
# drops at the start, and at the end by the length that the shifted value has modulo 3.
DASHES = ("-", "/", "–", "—", "―")
OFFSET_STARTS = (0, 2, 3)
OFFSET_ENDS = (0, 3, 2)
_DASH = re.compile(r"\B[-/]\b", re.ASCII)
_MOST_DASHES = 6
_PLACEHOLDER = re.compile(r"%[A-Za-z0-9_.-]+%")


class BadValue(ValueError):
    """A value or modifier that a rule can't use."""


def value_text(value: object) -> str:
    """The text of a YAML value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, Stamp) or not isinstance(value, str | int | float):
        raise BadValue(f"no scalar value: {value!r}")
    if isinstance(value, float):
        return go_float(value)
    return str(value)


def go_float(x: float) -> str:
    """Shortest text of a float: plain for exponents from -4 to 5, else with an exponent of two digits or more."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if str(x).startswith("-") else "0"
    exact = Decimal(repr(abs(x))).normalize()
    figures = "".join(map(str, exact.as_tuple().digits))
    power = exact.adjusted()
    sign = "-" if x < 0 else ""
    if -4 <= power < 6:
        return sign + format(exact, "f")
    return f"{sign}{figures[0]}{'.' + figures[1:] if len(figures) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"


def as_bytes(value: str | bytes) -> bytes:
    return value if isinstance(value, bytes) else value.encode()


def base64_offsets(value: bytes) -> list[str]:
    """The text that the value leaves in base64 at each of the three alignments."""
    out = []
    for shift, start in enumerate(OFFSET_STARTS):
        drop = OFFSET_ENDS[(len(value) + shift) % 3]
        text = base64.b64encode(b" " * shift + value).decode()
        out.append(text[start : len(text) - drop])
    return out


def windash(value: str) -> list[str]:
    """The value with each dash that leads an argument in all its forms."""
    spots = [m.start() for m in _DASH.finditer(value)][:_MOST_DASHES]
    out = []
    for marks in product(DASHES, repeat=len(spots)):
        chars = list(value)
        for at, mark in zip(spots, reversed(marks)):
            chars[at] = mark
        out.append("".join(chars))
    return out


def _text(value: str | bytes) -> str:
    return value.decode("utf-8", "surrogateescape") if isinstance(value, bytes) else value


#: name -> function from a value to its candidates.
VALUE_MODIFIERS: dict[str, Callable[[str | bytes], list]] = {
    "base64": lambda v: [base64.b64encode(as_bytes(v)).decode()],
    "base64offset": lambda v: base64_offsets(as_bytes(v)),
    "utf16le": lambda v: [_text(v).encode("utf-16-le")],
    "wide": lambda v: [_text(v).encode("utf-16-le")],
    "utf16be": lambda v: [_text(v).encode("utf-16-be")],
    "utf16": lambda v: [b"\xff\xfe" + _text(v).encode("utf-16-le")],
    "windash": lambda v: windash(_text(v)),
}


def _column_base64(c: Column) -> Column:
    return F.encode(base64_text(c), "UTF-8")


def _column_offsets(c: Column) -> list[Column]:
    """base64_offsets of a column of bytes."""
    out = []
    for shift, start in enumerate(OFFSET_STARTS):
        text = base64_text(F.concat(F.lit(b" " * shift), c) if shift else c)
        drop = F.element_at(F.array(*map(F.lit, OFFSET_ENDS)), (F.octet_length(c) + shift) % 3 + 1)
        out.append(F.encode(F.substring(text, F.lit(start + 1), F.length(text) - start - drop), "UTF-8"))
    return out


def _wide(charset: str, mark: bytes = b"") -> Callable[[Column], list[Column]]:
    return lambda c: [F.concat(F.lit(mark), F.encode(c.cast("string"), charset)) if mark else F.encode(c.cast("string"), charset)]


#: The same for values of another field, as columns of bytes.
COLUMN_MODIFIERS: dict[str, Callable[[Column], list[Column]]] = {
    "base64": lambda c: [_column_base64(c)],
    "base64offset": _column_offsets,
    "utf16le": _wide("UTF-16LE"),
    "wide": _wide("UTF-16LE"),
    "utf16be": _wide("UTF-16BE"),
    "utf16": _wide("UTF-16LE", b"\xff\xfe"),
}


def register_value_modifier(name: str, of_text: Callable[[str | bytes], list], of_column: Callable[[Column], list[Column]] | None = None) -> None:
    """Adds a value modifier: a function from a rule's value to its candidates and, for references, from a column of bytes to such columns."""
    VALUE_MODIFIERS[name] = of_text
    if of_column is not None:
        COLUMN_MODIFIERS[name] = of_column



def candidates(text: str, modifiers: Iterable[str]) -> list[str | None]:
    """All forms of a value after the chain of modifiers; None for bytes that are no text."""
    values: list = [text]
    for name in modifiers:
        values = [x for v in values for x in VALUE_MODIFIERS[name](v)]
    out: list[str | None] = []
    for v in values:
        try:
            out.append(v.decode() if isinstance(v, bytes) else v)
        except UnicodeDecodeError:
            out.append(None)
    return out


Expander = Callable[[str], Iterable[object]]


def expander_of(source: Expander | dict | None) -> Expander | None:
    """A dict of name -> values, with or without percent signs, as a function of %name%."""
    if source is None or callable(source):
        return source

    def expand(name: str) -> Iterable[object]:
        bare = name.strip("%")
        if name in source or bare in source:
            found = source.get(name, source.get(bare))
            return found if isinstance(found, list | tuple | set | frozenset) else [found]
        raise BadValue(f"no values for placeholder {name}")

    return expand


def expand_values(values: Iterable[object], expander: Expander | None, embedded: bool) -> list[str]:
    """Texts of values; a value that is one placeholder always expands, others inside only with `embedded`."""
    out: list[str] = []
    for value in values:
        text = value_text(value)
        if len(text) > 2 and text.startswith("%") and text.endswith("%") and _PLACEHOLDER.fullmatch(text):
            if expander is None:
                raise BadValue(f"no expander for {text}")
            out += [value_text(v) for v in expander(text)]
        elif embedded and (found := _PLACEHOLDER.findall(text)):
            if expander is None:
                raise BadValue(f"no expander for {text}")
            rest = _PLACEHOLDER.split(text)
            choices = [[value_text(v) for v in expander(f)] for f in found]
            out += ["".join(a + b for a, b in zip(rest, [*combo, ""])) for combo in product(*choices)]
        else:
            out.append(text)
    return out
