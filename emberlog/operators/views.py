"""What an analyst looks at: endpoints, detections, rules, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import micros

LEVELS = ("critical", "high", "medium", "low")
ONLINE_S, OFFLINE_S, KEEP_S = 300, 1800, 1800


def clamp(n: int | None, default: int, most: int) -> int:
    """A page size: the default outside 1..most."""
    return n if n is not None and 1 <= n <= most else default


def newest_endpoints(endpoints: DataFrame, n: int | None = 200) -> DataFrame:
    df = endpoints.orderBy(F.desc("last_seen"), "endpoint_id")
    return df if n is None else df.limit(n)


def newest_detections(detections: DataFrame, n: int | None = None, key: str = "detection_id") -> DataFrame:
    return detections.orderBy(F.desc(key)).limit(clamp(n, 200, 1000))


def rules_with_counts(rules: DataFrame, detections: DataFrame, n: int | None = None) -> DataFrame:
    """Rules, newest first, with how many detections each has; joined on the durable identity."""
    counts = detections.groupBy("rule_uid").agg(F.count(F.lit(1)).alias("detections"))
    return rules.join(counts, "rule_uid", "left").withColumn("detections", F.coalesce("detections", F.lit(0))).orderBy(F.desc("rule_id")).limit(clamp(n, 1000, 5000))


def severity_counts(detections: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Detections by lower-case severity; missing ones count as low, unknown ones only if they are kept."""
    out = detections.groupBy(F.lower(F.coalesce(F.nullif("severity", F.lit("")), F.lit("low"))).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return out if keep_unknown else out.where(F.col("severity").isin(*LEVELS))


def by_severity(detections: DataFrame, severity: str = "all") -> DataFrame:
    return detections if severity == "all" else detections.where(F.lower("severity") == severity)


def endpoint_state(endpoints: DataFrame, as_of: Column) -> DataFrame:
    """How many endpoints were seen less than five minutes ago, and how many not for half an hour."""
    age = micros(as_of) - micros("last_seen")
    return endpoints.agg(F.count(F.lit(1)).alias("total"), F.count_if(age < ONLINE_S * 1_000_000).alias("online"), F.count_if(age >= OFFLINE_S * 1_000_000).alias("offline"))


def alive(endpoints: DataFrame, as_of: Column, ttl_s: int | None, default_ttl_s: int | None = None) -> DataFrame:
    """Endpoints not older than the time to live; without one, all."""
    ttl = ttl_s or default_ttl_s
    return endpoints if not ttl else endpoints.where(micros(as_of) - micros("last_seen") <= ttl * 1_000_000)


def merge_alerts(old: DataFrame, new: DataFrame, as_of: Column, keep_s: int = KEEP_S) -> DataFrame:
    """Alerts once by id, not older than half an hour, newest first."""
    both = old.unionByName(new).where(micros(as_of) - micros("occurred_at") <= keep_s * 1_000_000)
    return both.dropDuplicates(["id"]).orderBy(F.desc("occurred_at"), "id")


def timeline(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
