"""Named text transforms; what can't be transformed becomes null."""

from __future__ import annotations

import gzip
import html
import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_B64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def base64_decode(c: Column) -> Column:
    """Strict standard alphabet and padding; line breaks are passed over."""
    t = F.regexp_replace(c, "[\r\n]", "")
    return F.when(t.rlike(_B64), F.try_validate_utf8(F.decode(F.unbase64(t), "UTF-8")))


def base64offset_decode(c: Column) -> Column:
    """The first of the offsets 0 to 3 that decodes."""
    return F.coalesce(*[F.when(F.char_length(c) >= k, base64_decode(F.substring(c, k + 1, 1 << 30))) for k in range(4)])


def _python(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v))

    return run


def _lenient_unquote(t: str) -> str:
    return urllib.parse.unquote(t, errors="replace")


def url_decode(c: Column) -> Column:
    """Query decoding (plus is a space); where an escape is malformed, the others are still resolved."""
    good = ~c.rlike(r"%(?![0-9A-Fa-f]{2})")
    return F.when(good, F.try_url_decode(c)).otherwise(F.when(~good, _python(_lenient_unquote)(c)))


def url_encode(c: Column) -> Column:
    """Unreserved characters stay, a space is %20."""
    t = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def html_decode(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("&")), _python(html.unescape)(c)).otherwise(c)


def identity(c: Column) -> Column:
    return c


def wide_decode(c: Column) -> Column:
    return F.translate(c, "\0", "")


#: White space as Unicode counts it.
_WS = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def normalize_whitespace(c: Column) -> Column:
    return F.regexp_replace(trim(c), f"{_WS}+", " ")


def remove_whitespace(c: Column) -> Column:
    return F.translate(c, " \t\n\r", "")


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), "/{2,}", "/")


def basename(c: Column) -> Column:
    t = normalize_path(c)
    bare = F.regexp_replace(t, "/+$", "")
    return F.when(t == "", F.lit(".")).when(bare == "", F.lit("/")).otherwise(F.regexp_extract(bare, r"(?s)([^/]*)$", 1))


def dirname(c: Column) -> Column:
    t = normalize_path(c)
    return F.when(~t.contains("/"), F.lit(".")).when(t.rlike(r"(?s)^/[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(t, r"(?s)^(.*)/[^/]*$", 1))


def hex_decode(c: Column) -> Column:
    t = F.translate(c, " -", "")
    return F.when(t.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.try_validate_utf8(F.decode(F.unhex(t), "UTF-8")))


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c))


def json_normalize(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\n\t", ""), " {2,}", " ")


def csv_extract(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.split_part(c, F.lit(","), F.lit(1))), '^"+|"+$', "")


def to_int(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[+-]?[0-9]+$") & t.try_cast("long").isNotNull(), t)


def to_float(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t)


def gzip_decode(c: Column) -> Column:
    """Unpacks text whose characters are the bytes of a gzip stream; other text stays."""

    def unpack(t: str) -> str:
        try:
            return gzip.decompress(t.encode("latin-1")).decode("utf-8", "replace")
        except (OSError, EOFError, UnicodeEncodeError):
            return t

    return F.when(c.startswith("\x1f\x8b"), _python(unpack)(c)).otherwise(c)


Transform = Callable[[Column], Column]
DEFAULTS: dict[str, Transform] = {"base64_decode": base64_decode, "base64": base64_decode, "utf16_decode": identity, "utf16le_decode": identity, "utf16be_decode": identity}
TRANSFORMS: dict[str, Transform] = DEFAULTS | {
    "base64offset_decode": base64offset_decode, "url_decode": url_decode, "url_encode": url_encode, "html_decode": html_decode, "wide_decode": wide_decode,
    "lowercase": F.lower, "uppercase": F.upper, "trim": trim, "reverse": F.reverse, "normalize_whitespace": normalize_whitespace, "remove_whitespace": remove_whitespace,
    "normalize_path": normalize_path, "basename": basename, "dirname": dirname, "hex_decode": hex_decode, "hex_encode": hex_encode,
    "json_extract": identity, "xml_extract": identity, "regex_extract": identity, "unix_timestamp": identity, "iso_timestamp": identity,
    "json_normalize": json_normalize, "csv_extract": csv_extract, "to_int": to_int, "to_float": to_float,
    "md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "gzip_decode": gzip_decode, "gzip": gzip_decode,
}


def apply_chain(c: Column, names: list[str] | tuple[str, ...], table: dict[str, Transform] | None = None) -> Column:
    """Transforms one after another; an unknown name is an error."""
    table = TRANSFORMS if table is None else table
    for n in names:
        if n.lower() not in table:
            raise KeyError(f"unknown transform {n!r}")
        c = table[n.lower()](c)
    return c
