"""Access to the fields of an event, as text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALARS = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def scalar_texts(text: str | None) -> list[str]:
    """Every scalar of a JSON document as text, nulls left out; invalid JSON has none."""
    out: list[str] = []
    try:
        stack = [json.loads(text, parse_int=str, parse_float=str)] if text is not None else []
    except ValueError:
        return out
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v
        elif isinstance(v, bool):
            out.append("true" if v else "false")
        elif v is not None:
            out.append(v)
    return out


def _scalars_udf() -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scalars(s: pd.Series) -> pd.Series:
        return s.map(scalar_texts)

    return scalars


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_path(name: str) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in name.split("."))


class JsonEvents:
    """Fields of a column with raw JSON: nested names by dots, a name without dots at the top."""

    def __init__(self, column: str = "event"):
        self.column = column

    def field(self, name: str) -> Column:
        """Text of a scalar; null if it's absent, null, an array or an object."""
        raw = F.col(self.column)
        value = F.get_json_object(raw, json_path(name))
        # a text may look like an array or object, so only such values are looked at twice
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), json_path(name), "variant"))
        nested = F.coalesce(kind.rlike("^(ARRAY|OBJECT)"), F.lit(False))
        value = F.when(value.rlike(r"^[\[{]") & nested, F.lit(None).cast("string")).otherwise(value)
        leaf = name.split(".")[-1]
        if not re.fullmatch(r"[A-Za-z0-9_@ -]+", leaf):
            return value
        # a text without the key needn't be parsed; escapes may spell it otherwise
        return F.when(F.contains(raw, F.lit(leaf)) | F.contains(raw, F.lit("\\u")), value)

    def flat(self, name: str) -> Column:
        """A top-level key that may itself hold dots."""
        return F.get_json_object(F.col(self.column), "$['" + name.replace("'", "\\'") + "']")

    def all_values(self) -> Column:
        return _scalars_udf()(F.col(self.column))


class TypedEvents:
    """Fields of typed columns; only the named ones are offered."""

    def __init__(self, df: DataFrame, names: dict[str, str | Column] | None = None):
        scalars = [f.name for f in df.schema.fields if isinstance(f.dataType, _SCALARS)]
        self.names = {n: n for n in scalars} if names is None else dict(names)

    def _get(self, name: str) -> Column | None:
        c = self.names.get(name)
        return None if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")

    def field(self, name: str) -> Column:
        c = self._get(name)
        return F.lit(None).cast("string") if c is None else c

    flat = field

    def all_values(self) -> Column:
        return F.array_compact(F.array(*[self._get(n) for n in self.names]))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def basename_lower(c: Column) -> Column:
    """File name of a path with either kind of slash, in lower case; a path that ends with one stays whole."""
    return F.lower(F.when(c.endswith("/") | c.endswith("\\"), c).otherwise(F.regexp_replace(c, r"(?s)^.*[\\/]", "")))


def endpoint_columns(e, fall_back_to_host: bool = False) -> dict[str, Column]:
    """endpoint_id, host_name, ip, agent_version of an event; keys with dots are flat."""
    nested_host = e.field("host.name") if isinstance(e, JsonEvents) else e.field("host.name")
    host = first_present(nested_host, e.flat("host.name"), e.flat("hostname"))
    ids = [e.flat("endpoint_id"), e.flat("agent.id"), e.flat("agent_id")]
    return {
        "endpoint_id": F.coalesce(first_present(*ids, *([host] if fall_back_to_host else [])), F.lit("")),
        "host_name": F.coalesce(host, F.lit("")),
        "ip": F.coalesce(e.flat("ip"), F.lit("")),
        "agent_version": F.coalesce(first_present(e.flat("agent.version"), e.flat("agent_version")), F.lit("")),
    }


def process_columns(e) -> dict[str, Column]:
    """Process attributes from the common layouts, in order of preference; each name is tried flat, then nested."""
    both = lambda n: F.coalesce(e.flat(n), e.field(n)) if "." in n else e.flat(n)
    data = lambda n: [both(f"event_data.{n}"), both(f"winlog.event_data.{n}")]
    text = lambda *cs: F.coalesce(first_present(*[F.trim(c) for c in cs]), F.lit(""))
    return {
        "endpoint_id": text(both("endpoint_id"), both("agent.id"), both("agent_id"), both("host.name")),
        "entity_id": text(both("process.entity_id"), *data("ProcessGuid")),
        "parent_entity_id": text(both("process.parent.entity_id"), *data("ParentProcessGuid")),
        "pid": text(both("process.pid"), *data("ProcessId")),
        "ppid": text(both("process.parent.pid"), *data("ParentProcessId")),
        "name": text(both("process.name"), *data("ProcessName")),
        "executable": text(both("process.executable"), *data("Image"), both("Image")),
        "command_line": text(both("process.command_line"), *data("CommandLine"), both("CommandLine")),
        "ts": F.coalesce(F.try_to_timestamp(both("@timestamp")), F.try_to_timestamp(both("event.ingested"))),
    }


def node_key(entity: Column, pid: Column) -> Column:
    """entity id, else pid:<pid>; null if there is neither."""
    return F.coalesce(F.nullif(entity, F.lit("")), F.when(F.coalesce(pid, F.lit("")) != "", F.concat(F.lit("pid:"), pid)))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
