"""Wildcard texts and regular expressions of rules as Java patterns, all made on the driver."""

from __future__ import annotations

import re

MANY, ONE = object(), object()


def tokens(text: str) -> list:
    """Characters and wildcards of a value; backslash escapes only `*`, `?` and itself."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in "*?\\":
            out.append(text[i + 1])
            i += 2
            continue
        out.append(MANY if c == "*" else ONE if c == "?" else c)
        i += 1
    return out


def has_wildcard(text: str) -> bool:
    return any(t is MANY or t is ONE for t in tokens(text))


def literal(text: str) -> str:
    """A value without wildcards, its escapes resolved."""
    return "".join(t for t in tokens(text) if isinstance(t, str))


def escape_value(text: str) -> str:
    """A value that stands for exactly this text."""
    return re.sub(r"([*?\\])", r"\\\1", text)


def java_quote(text: str) -> str:
    """Characters as themselves in a Java pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#/" else c for c in text)


def wildcard_regex(text: str, start: bool, end: bool, cased: bool) -> str:
    """The Java pattern of a wildcard value; start, end: whether it is anchored there."""
    body = "".join(".*" if t is MANY else "." if t is ONE else java_quote(t) for t in tokens(text))
    return ("(?s)" if cased else "(?isu)") + ("\\A" if start else "") + body + ("\\z" if end else "")


def keyword_regex(text: str, cased: bool) -> str:
    """Keywords have wildcards but no escapes, and `.` stops at a newline."""
    body = "".join(".*" if c == "*" else "." if c == "?" else java_quote(c) for c in text)
    return ("(?d)" if cased else "(?iud)") + body


class InvalidPattern(ValueError):
    """What RE2 doesn't accept."""


_POSIX = {"alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}", "graph": "\\p{Graph}", "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\t\\n\\x0B\\f\\r ", "upper": "\\p{Upper}", "word": "\\w", "xdigit": "\\p{XDigit}"}
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


def _char_class(text: str, i: int) -> tuple[str, int]:
    """A bracketed class from its `[`; Java would read a nested `[` and `&&` as operators."""
    out, i = ["["], i + 1
    if text[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(text):
        c = text[i]
        if c == "]" and not first:
            return "".join(out) + "]", i + 1
        first = False
        if m := re.match(r"\[:(\^?)([a-z]+):\]", text[i:]):
            if m[2] not in _POSIX:
                raise InvalidPattern(f"unknown class {m[2]}")
            name = _POSIX[m[2]]
            out.append(f"[^{name}]" if m[1] else name)
            i += m.end()
        elif c == "\\":
            e, i = _escape(text, i, True)
            out.append(e)
        else:
            out.append("\\" + c if c in "[]&~#^" and c != "-" else c)
            i += 1
    raise InvalidPattern("missing ]")


def _escape(text: str, i: int, inside: bool) -> tuple[str, int]:
    c = text[i + 1 : i + 2]
    if not c:
        raise InvalidPattern("trailing backslash")
    if c == "s":
        return ("\\t\\n\\f\\r " if inside else "[\\t\\n\\f\\r ]"), i + 2
    if c == "S":
        return ("\\S" if inside else "[^\\t\\n\\f\\r ]"), i + 2
    if c == "v":
        return "\\x0B", i + 2
    if c == "Q" and not inside:
        end = text.find("\\E", i)
        body = text[i + 2 : end if end >= 0 else len(text)]
        return java_quote(body), end + 2 if end >= 0 else len(text)
    if m := re.match(r"\\([0-7]{3}|0[0-7]{0,2})", text[i:]):
        return f"\\x{{{int(m[1] or '0', 8):x}}}", i + m.end()
    if m := re.match(r"\\[pP](?:[A-Z]|\{\^?[A-Za-z_]+\})", text[i:]):
        name = m[0]
        if "{^" in name:
            name = ("\\P" if name[1] == "p" else "\\p") + name[2:].replace("{^", "{")
        if (script := re.fullmatch(r"(\\[pP])\{([A-Z][a-z_A-Z]{3,})\}", name)) :
            name = f"{script[1]}{{Is{script[2]}}}"
        return name, i + m.end()
    if m := re.match(r"\\x(?:[0-9A-Fa-f]{2}|\{[0-9A-Fa-f]{1,6}\})", text[i:]):
        return m[0], i + m.end()
    if c in "dDwWafnrt" or (c in "bBAz" and not inside):
        return "\\" + c, i + 2
    if c.isascii() and not c.isalnum():
        return "\\" + c, i + 2
    raise InvalidPattern(f"bad escape \\{c}")


def re2_to_java(pattern: str, flags: str = "") -> str:
    """A Java pattern that finds what RE2 finds; InvalidPattern for what RE2 rejects. flags: of i, m, s."""
    out, i, multi, names = [], 0, "m" in flags, 0
    quantified = False  # whether what stands before is a repeat, which RE2 doesn't stack
    atom = False
    while i < len(pattern):
        c = pattern[i]
        if c in "*+?" or c == "{" and _REPEAT.match(pattern, i):
            m = _REPEAT.match(pattern, i) if c == "{" else None
            if not atom or quantified:
                raise InvalidPattern(f"bad repetition at {i}")
            if m:
                low, high = int(m[1]), int(m[3]) if m[3] else None
                if low > 1000 or (high is not None and (high > 1000 or high < low)):
                    raise InvalidPattern("bad repeat count")
            part = m[0] if m else c
            i += len(part)
            if pattern[i : i + 1] == "?":
                part += "?"
                i += 1
            out.append(part)
            quantified = True
            continue
        quantified = False
        if c == "\\":
            part, i = _escape(pattern, i, False)
            atom = True
        elif c == "[":
            part, i = _char_class(pattern, i)
            atom = True
        elif c == "(":
            atom = False
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:]):
                names += 1
                part = f"(?<g{names}n{re.sub('[^A-Za-z0-9]', '', m[1])}>"
                i += m.end()
            elif m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", pattern[i:]):
                if "U" in m[1] + (m[2] or ""):
                    raise InvalidPattern("the ungreedy flag has no counterpart")
                multi = (multi or "m" in m[1]) and "m" not in (m[2] or "")
                off = f"-{m[2]}" if m[2] else ""
                part = f"(?{m[1].replace('i', 'iu')}{off}{m[3]}"
                i += m.end()
            elif pattern.startswith("(?", i):
                raise InvalidPattern("unsupported group")
            else:
                part, i = "(", i + 1
        elif c == "$":
            part, i, atom = ("$" if multi else "\\z"), i + 1, True
        elif c == "{":
            part, i, atom = "\\{", i + 1, True
        elif c == "}":
            part, i, atom = "\\}", i + 1, True
        elif c == "|":
            part, i, atom = "|", i + 1, False
        else:
            part, i, atom = ("\\" + c if c in "#" else c), i + 1, True
        out.append(part)
    java = "(?d" + flags.replace("i", "iu") + ")" + "".join(out)
    depth = 0
    for t in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|[()]", java[java.index(")") + 1 :]):
        depth += (t == "(") - (t == ")")
        if depth < 0:
            raise InvalidPattern("unexpected )")
    if depth:
        raise InvalidPattern("missing )")
    return java


def required_text(pattern: str, flags: str = "") -> str:
    """The longest run of plain characters that every match must hold, or ''. Only for patterns without alternatives, groups and flags."""
    if "i" in flags or re.search(r"[|()]", pattern):
        return ""
    best = now = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        step = 1
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            c, step = pattern[i + 1], 2
        elif c in "\\.[^$":
            if c == "\\":
                return best if len(best) >= len(now) else now
            best, now = max(best, now, key=len), ""
            if c == "[":
                return best
            i += 1
            continue
        elif c in "*+?{":
            now = now[:-1] if c in "*?{" else now
            best, now = max(best, now, key=len), ""
            if c == "{":
                return best
            i += 1
            continue
        now += c
        i += step
    return max(best, now, key=len)
