"""Match predicates: a text column against values, as boolean columns that are never null."""

from __future__ import annotations

import ipaddress
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number: no suffixes such as 1d, which a cast alone would take.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _never() -> Column:
    return F.lit(False)


def any_of(parts: list[Column]) -> Column:
    out = _never()
    for i, p in enumerate(parts):
        out = p if i == 0 else out | p
    return out


def all_of(parts: list[Column]) -> Column:
    out = F.lit(True)
    for i, p in enumerate(parts):
        out = p if i == 0 else out & p
    return out


def equals(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """Whole text, without regard to case unless case_sensitive; stars and question marks are themselves."""
    if "case_sensitive" in modifiers:
        return c.isin(list(values))
    return F.lower(c).isin([v.lower() for v in values])


def contains(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    low = F.lower(c)
    parts = [low.contains(v.lower()) for v in values]
    return all_of(parts) if "all" in modifiers else any_of(parts)


def startswith(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    return any_of([F.lower(c).startswith(v.lower()) for v in values])


def endswith(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    return any_of([F.lower(c).endswith(v.lower()) for v in values])


def java_pattern(pattern: str) -> str | None:
    """The pattern for Java, or None where it isn't a linear-time pattern (look-around, back-references) or is malformed."""
    if re.search(r"\(\?<?[=!]|\(\?>|\\[1-9]|\\k<|[*+?}]\+", pattern):
        return None
    named = re.sub(r"\(\?P<", "(?<", pattern)
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\[pP](?:\{\^?\w+\}|\w)|\\[zQE]", "x", re.sub(r"\[\[:\^?\w+:\]", "[x", named))))
    except re.error:
        try:
            from pyspark import SparkContext

            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(named)
        except Exception:
            return None
    return re.sub(r"\[:(\w+):\]", lambda m: {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}"}.get(m[1], r"\w"), named)


def regex(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """Found anywhere; values after one that is no pattern aren't tried."""
    parts = []
    for v in values:
        p = java_pattern(v)
        if p is None:
            break
        parts.append(c.rlike(p))
    return any_of(parts)


def _number(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), F.regexp_replace(t, "(?i)^([+-]?)inf$", "$1Infinity").try_cast("double"))


def _go_float(text: str) -> float | None:
    t = text.strip()
    return float(t) if re.match(_NUMBER, t) else None


def range_basic(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """"lo-hi", both included; a value that isn't two numbers ends the search."""
    n, parts = _number(c), []
    for v in values:
        lo, dash, hi = v.partition("-")
        a, b = _go_float(lo), _go_float(hi) if dash else None
        if a is None or b is None:
            break
        parts.append((n >= F.lit(a)) & (n <= F.lit(b)) & ~F.isnan(n))
    return any_of(parts)


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def range_advanced(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """a..b (both included), a...b (without b), >, >=, <, <=, a-b, or one number.

    Whole numbers are compared as such, so they stay exact beyond 2**53.
    """
    text, number = F.trim(c), _number(c)
    whole = F.when(text.rlike(r"^[+-]?[0-9]{1,19}$"), text.try_cast("long"))

    def compare(op: str, bound: str) -> Column:
        f = _go_float(bound)
        if re.fullmatch(r"[+-]?[0-9]{1,18}", bound.strip()):
            return F.when(whole.isNotNull(), _COMPARE[op](whole, F.lit(int(bound)))).otherwise(_COMPARE[op](number, F.lit(f)))
        return _COMPARE[op](number, F.lit(f))

    parts = []
    for v in values:
        v = v.strip()
        op = next((o for o in (">=", "<=", ">", "<") if v.startswith(o)), None)
        if op:
            bounds = [(op, v[len(op) :])]
        elif "..." in v:
            a, b = v.split("...", 1)
            bounds = [(">=", a), ("<", b)]
        elif ".." in v:
            a, b = v.split("..", 1)
            bounds = [(">=", a), ("<=", b)]
        elif "-" in v[1:]:
            k = v.index("-", 1)
            bounds = [(">=", v[:k]), ("<=", v[k + 1 :])]
        else:
            bounds = [(">=", v), ("<=", v)]
        if any(_go_float(b) is None for _, b in bounds):
            break
        parts.append(all_of([compare(o, b) for o, b in bounds]) & ~F.coalesce(F.isnan(number), F.lit(False)))
    return any_of(parts)


def similarity(c: Column, value: str) -> Column:
    """1 - edit distance over the longer length, in characters; equal texts 1, one empty text 0."""
    longest = F.greatest(F.char_length(c), F.lit(len(value)))
    return F.when(c == F.lit(value), F.lit(1.0)).when((c == "") | F.lit(value == ""), F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(c, F.lit(value)) / longest)


def _threshold(modifiers: tuple[str, ...], prefixes: tuple[str, ...], strict: bool) -> float | None:
    out = 0.8
    for m in modifiers:
        for p in prefixes:
            if m.startswith(p):
                x = _go_float(m[len(p) :])
                if x is None:
                    if strict:
                        return None
                elif strict or (0 <= x <= 1 and not math.isnan(x)):
                    out = x
    return out


def fuzzy_basic(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """Similar enough (threshold:x, 0.8 without); a threshold that is no number makes it false."""
    t = _threshold(modifiers, ("threshold:",), True)
    return _never() if t is None else any_of([similarity(c, v) >= F.lit(t) for v in values])


def fuzzy_advanced(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """Also fuzzy:x; thresholds outside 0 to 1 are passed over."""
    t = _threshold(modifiers, ("threshold:", "fuzzy:"), False)
    return any_of([similarity(c, v) >= F.lit(t) for v in values])


_OCTETS = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def ipv4_number(c: Column) -> Column:
    """A dotted address as a long; null for other text."""
    t = F.trim(c)
    part = lambda i: F.split_part(t, F.lit("."), F.lit(i)).try_cast("long")
    return F.when(t.rlike(_OCTETS), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def _ipv6_in(networks: list[str]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.BooleanType())
    def inside(s: pd.Series) -> pd.Series:
        nets = [ipaddress.ip_network(n, strict=False) for n in networks]

        def one(text: str | None) -> bool:
            try:
                a = ipaddress.ip_address(text.strip())
            except (ValueError, AttributeError):
                return False
            a = getattr(a, "ipv4_mapped", None) or a
            return any(a.version == n.version and a in n for n in nets)

        return s.map(one)

    return inside


def networks(values: list[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """The networks that values name, up to one that names none."""
    out = []
    for v in values:
        try:
            if "/" not in v:
                break
            out.append(ipaddress.ip_network(v.strip(), strict=False))
        except ValueError:
            break
    return out


def address(text: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a text is, as ``cidr`` reads it."""
    if re.match(_OCTETS, text.strip(" ")):
        return ipaddress.IPv4Address(text.strip(" "))
    try:
        found = ipaddress.IPv6Address(text.strip()) if ":" in text else None
    except ValueError:
        return None
    return None if found is not None and found.ipv4_mapped else found


def cidr(c: Column, values: list[str], modifiers: tuple[str, ...] = ()) -> Column:
    """In one of the networks; a value that is none ends the search.  Version 4 stays in the JVM; version 6 takes a vectorised function, run only for text with a colon."""
    number, nets = ipv4_number(c), networks(values)
    four = [(number >= F.lit(int(n.network_address))) & (number <= F.lit(int(n.broadcast_address))) for n in nets if n.version == 4]
    six = [str(n) for n in nets if n.version == 6]
    out = F.coalesce(any_of(four), _never())
    return out | F.coalesce(F.when(F.contains(c, F.lit(":")), _ipv6_in(six)(c)), _never()) if six else out


Matcher = Callable[[Column, list[str], tuple[str, ...]], Column]
MATCHERS: dict[str, Matcher] = {"equals": equals, "exact": equals, "contains": contains, "startswith": startswith, "endswith": endswith, "regex": regex, "cidr": cidr, "range": range_basic, "fuzzy": fuzzy_basic}
ADVANCED: dict[str, Matcher] = {"range": range_advanced, "fuzzy": fuzzy_advanced}


def is_literal(value: str, builder: bool = False) -> bool:
    """Whether a value has no wildcard (for a builder: nor the start of a class)."""
    return not any(ch in value for ch in ("*?[^" if builder else "*?"))


def wildcard_pattern(value: str) -> str:
    """The rule standard's * and ? (a backslash escapes) as a whole-text pattern."""
    out, i = [], 0
    while i < len(value):
        if value[i] == "\\" and value[i + 1 : i + 2] in ("*", "?", "\\"):
            i += 1
            out.append(re.escape(value[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(value[i]) or re.escape(value[i]))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def two_valued(p: Column) -> Column:
    """Absent fields and errors are false, so that a negation of them is true."""
    return F.coalesce(p, F.lit(False))
