"""Sources of events and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import JsonEvents, first_present, let


def parse_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Ingest bodies to events: an object is one, an array its objects (others are dropped), anything else an error.

    Adds ``event`` (raw JSON) or, on a row of its own, ``error``.
    """
    c = F.trim(F.col(column))
    parsed = F.try_parse_json(c)
    kind = F.schema_of_variant(parsed)
    items = F.when(kind.startswith("OBJECT"), F.array(c)).when(kind.startswith("ARRAY"), F.filter(F.from_json(c, T.ArrayType(T.StringType())), lambda x: x.rlike(r"^\s*\{")))
    rows = payloads.withColumn("error", F.when(parsed.isNull() | ~kind.rlike("^(OBJECT|ARRAY)"), F.lit("payload must be an object or an array"))).withColumn("_items", items)
    return rows.select("*", F.explode_outer("_items").alias("event")).drop("_items").where(F.col("event").isNotNull() | F.col("error").isNotNull())


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One raw event a line."""
    return spark.read.text(path).select(F.col("value").alias("event"))


#: Names that the Windows shipper changes.
WINDOWS_NAMES = {"host.name": "host_name", "host.ip": "ip", "@timestamp": "timestamp", "winlog.event_id": "event_id", "winlog.provider_name": "provider_name", "winlog.channel": "channel"}
WINDOWS_AGENT = "winlogbeat-8.11.0"


def windows_feed(events: DataFrame, column: str = "event", data: tuple[str, ...] = ("Image", "CommandLine", "ParentImage", "User", "ProcessId", "ParentProcessId", "ProcessGuid", "ParentProcessGuid")) -> DataFrame:
    """Windows log records: renamed, event data flattened to event_data.<name>, endpoint and agent added."""
    e = JsonEvents(column)
    both = lambda n: F.coalesce(e.flat(n), e.field(n))
    names = [both(a).alias(b) for a, b in WINDOWS_NAMES.items()]
    flat = [both(f"winlog.event_data.{d}").alias(f"event_data.{d}") for d in data]
    return events.select(*names, *flat, both("host.name").alias("endpoint_id"), F.lit(WINDOWS_AGENT).alias("agent.version"))


def journal_feed(events: DataFrame, column: str = "event") -> DataFrame:
    """Journal records of the secure shell to the engine's names."""
    e = JsonEvents(column)
    f = e.flat
    return events.select(f("_MACHINE_ID").alias("endpoint_id"), f("_HOSTNAME").alias("hostname"), F.coalesce(f("MESSAGE"), F.lit("")).alias("message"), f("_EXE").alias("Image"), f("_COMM").alias("ProcessName"), f("_CMDLINE").alias("CommandLine"), f("_SYSTEMD_UNIT").alias("ServiceName"), f("SYSLOG_IDENTIFIER").alias("EventID"), F.struct(F.lit("linux").alias("product"), F.lit("sshd").alias("service")).alias("event"))


def journal_normalise(events: DataFrame, column: str = "event") -> DataFrame:
    """Any journal record, with fallbacks; priorities 0 to 3 count as denied."""
    f = JsonEvents(column).flat
    prio = f("PRIORITY").try_cast("int")
    return events.select(
        F.coalesce(f("_HOSTNAME"), f("host")).alias("hostname"),
        F.coalesce(f("MESSAGE"), f("msg"), F.lit("")).alias("message"),
        f("SYSLOG_IDENTIFIER").alias("EventID"),
        F.coalesce(f("_EXE"), F.when(f("_COMM") != "", F.concat(F.lit("/usr/bin/"), f("_COMM")))).alias("Image"),
        f("_COMM").alias("ProcessName"),
        f("_CMDLINE").alias("CommandLine"),
        f("_UID").alias("TargetUserId"),
        f("USER").alias("TargetUserName"),
        f("_SYSTEMD_UNIT").alias("ServiceName"),
        f("_TRANSPORT").alias("Protocol"),
        prio.alias("priority"),
        F.when(prio <= 3, F.lit("deny")).otherwise(F.lit("allow")).alias("Action"),
        f("_MACHINE_ID").alias("MachineId"),
        f("_BOOT_ID").alias("BootId"),
    )


def key_values(text: Column) -> Column:
    """map of the key=value words of a text; quotes around values go, the last of equal keys stays."""
    words = F.regexp_extract_all(text, F.lit(r"""(?:^|\s)([^\s=]+=(?:"[^"]*"|\S*))"""), F.lit(1))

    def pair(w: Column) -> Column:
        raw = F.substring(w, F.instr(w, "=") + 1, F.length(w))
        value = F.when(F.contains(raw, F.lit('"')), F.regexp_replace(raw, '^"|"$', "")).otherwise(raw)
        return F.struct(F.substring_index(w, "=", 1).alias("key"), value.alias("value"))

    # backwards, the first of equal keys is the last of the text
    def last(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda p: p["key"]), lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1))

    return F.map_from_entries(F.reverse(let(F.reverse(F.transform(words, pair)), last)))


def audit_parse(lines: DataFrame, column: str = "message") -> DataFrame:
    """Audit records: time, number, and the keys of the record and of its quoted message."""
    m = F.col(column)
    sep, apart = "\x1d", "\x1d\x1d"
    # what comes before the record, the record, and what follows its separator, in one pass
    three = F.split(F.regexp_replace(m, rf"(?s)^(.*)\bmsg=(audit\(.*){sep}(.*)$", f"$1{apart}$2{apart}$3"), apart, -1)
    cut = lines.withColumn("_p", F.when(F.size(three) == 3, three))
    part = lambda i: F.coalesce(F.get("_p", F.lit(i)), F.lit(""))
    # "audit(time:number): " stands at the record's start
    head = r"(?s)^audit\(([0-9.]+):(\d+)\):\s*"
    known = cut.withColumn("_h", F.regexp_extract(part(1), head, 0))
    inside = F.regexp_replace("_h", r"^audit\(|\):\s*$", "")
    rest = F.substring(part(1), F.length("_h") + 1, F.length(part(1)))
    rest = F.when(rest == "", part(1)).otherwise(rest)
    body = F.regexp_replace(rest, r"(?s)^(.*)\bmsg='([^']*)'(.*)$", "$1 $2 $3")
    stamp = F.substring_index(inside, ":", 1).try_cast("decimal(20,6)")
    return known.select(*[known[c] for c in lines.columns], F.timestamp_micros((stamp * 1000000).cast("long")).alias("timestamp"), F.when(F.col("_h") != "", F.substring_index(inside, ":", -1)).try_cast("long").alias("seqno"), key_values(F.concat_ws(" ", part(0), part(2), body)).alias("fields"))


__all__ = ["audit_parse", "first_present", "journal_feed", "journal_normalise", "key_values", "parse_payloads", "read_ndjson", "windows_feed"]
