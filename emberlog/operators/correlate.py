"""Correlation: matches counted by group in windows that start at their first event.

A window lives while an event is no later than ``timespan`` after its start; an event after that starts a
new one.  When the count reaches the threshold an alert is raised and the window starts again, empty,
at that event.  Only the type value_count raises alerts; a timespan of zero restarts at every event.

Between two events further apart than the timespan a window always restarts, so a group's time is cut where a whole
stretch begins later than that after the last event before it, and the parts are folded apart.  A part is read in
order as a stream that carries (start, count), so no group is held in memory; one that never pauses is sequential by
definition.  The state left at a group's end can be put before its next events, so batch after batch gives what one
batch of all gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.fields import micros
from ..plans.ir import Correlation, Ruleset

TYPES = ("value_count", "event_count", "temporal", "temporal_ordered")


def rule_ids(ruleset: Ruleset, c: Correlation) -> list[int]:
    """Numbers of the rules that a correlation names; only rules with a name can be."""
    return sorted(r.rule_id for r in ruleset.rules if r.name and r.name in c.rules)


def group_label(c: Correlation, fields: dict[str, Column]) -> Column:
    """The present group fields as "f:v" in order, with the rule's name, as one digest; missing ones are left out."""
    parts = [F.when(fields[g].isNotNull(), F.concat(F.lit(f"{g}:"), fields[g].cast("string"))) for g in c.group_by if g in fields]
    return F.md5(F.concat_ws("|", F.lit(c.name), *parts).cast("binary"))


def triggers(events: DataFrame, ruleset: Ruleset, fields: dict[str, Column], key: str = "event_id", ts: str = "ts", matched: str = "matched") -> DataFrame:
    """(correlation, group_key, span_us, gte, ts, key) of every event that a correlation counts."""
    specs = []
    for i, c in enumerate(ruleset.correlations):
        ids = rule_ids(ruleset, c)
        if ids and c.type.lower() == "value_count" and c.vc_gte is not None:
            hit = F.exists(F.col(matched), lambda m: m.isin(ids))
            specs.append(F.when(hit, F.struct(F.lit(i).alias("correlation"), F.lit(c.name).alias("rule_name"), group_label(c, fields).alias("group_key"), F.lit(int(c.timespan_s * 1e6)).cast("long").alias("span_us"), F.lit(c.vc_gte).alias("gte"))))
    if not specs:
        specs = [F.lit(None).cast("struct<correlation:int,rule_name:string,group_key:string,span_us:bigint,gte:int>")]
    return events.select(F.col(key), F.col(ts), F.explode(F.array_compact(F.array(*specs))).alias("c")).select("c.*", micros(ts).alias("t"), F.col(ts).cast("timestamp").alias("ts"), F.col(key).alias("event_id"))


#: A group's stretches are so many timespans long.
STRETCH = 4


def _parts(counted: DataFrame) -> DataFrame:
    """counted with ``part`` (of a group, by pauses between stretches) and ``last`` (the group's last part)."""
    keys = ["rule_name", "group_key"]
    placed = counted.withColumn("stretch", F.when(F.col("span_us") > 0, F.floor(F.col("t") / (F.col("span_us") * STRETCH))).otherwise(F.floor(F.col("t") / 3_600_000_000)))
    ends = placed.groupBy(*keys, "stretch", "span_us").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("stretch")
    paused = F.coalesce(F.col("lo") - F.lag("hi").over(order) > F.col("span_us"), F.lit(False))
    cut = ends.withColumn("part", F.sum(paused.cast("int")).over(order)).withColumn("last", F.col("part") == F.sum(paused.cast("int")).over(Window.partitionBy(*keys)))
    return placed.join(cut.select(*keys, "stretch", "part", "last"), [*keys, "stretch"]).drop("stretch")


def fold_windows(counted: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Triggers to alerts and to the state that each group is left with (``is_state``).

    ``state``: rule_name, group_key, start, n of earlier batches.  Rows: correlation, rule_name, group_key, is_state, start, t,
    event_id, n.
    """
    columns = ["correlation", "rule_name", "group_key", "span_us", "gte", "part", "last", "seen", "t", "event_id", "n"]
    rows = _parts(counted).withColumn("seen", F.lit(1)).withColumn("n", F.lit(0)).select(*columns)
    if state is not None:
        old = state.join(counted.select("rule_name", "group_key").distinct(), ["rule_name", "group_key"], "left_semi")
        none = {"correlation": "int", "span_us": "long", "gte": "int", "event_id": counted.schema["event_id"].dataType}
        before = old.select("rule_name", "group_key", F.col("start").alias("t"), F.col("n").cast("int").alias("n"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("last"), F.lit(0).alias("seen"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        rows = rows.unionByName(before.select(*columns))
    rows = rows.repartition("rule_name", "group_key", "part").sortWithinPartitions("rule_name", "group_key", "part", "seen", "t", "event_id")
    kind = counted.schema["event_id"].dataType
    schema = T.StructType([*T.StructType.fromDDL("correlation int, rule_name string, group_key string, is_state boolean, start long, t long").fields, T.StructField("event_id", kind), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, n, ended = None, None, 0, None
        out: list[tuple] = []
        shape = None
        for b in batches:
            shape = shape or b.schema.field("event_id").type
            for c, name, key, span, gte, part, last, seen, t, event, count in zip(*[b.column(x).to_pylist() for x in columns], strict=True):
                if (name, key, part) != group:
                    if ended:
                        out.append((*ended, True, start, None, None, n))
                    group, start, n, ended = (name, key, part), None, 0, None
                if not seen:
                    start, n = t, count
                    continue
                if start is None or span == 0 or t - start > span:
                    start, n = t, 0
                n += 1
                if n >= gte:
                    out.append((c, name, key, False, start, t, event, n))
                    start, n = t, 0
                ended = (c, name, key) if last else None
            if len(out) > 10_000:
                yield _batch(out, shape)
                out = []
        if ended:
            out.append((*ended, True, start, None, None, n))
        if out:
            yield _batch(out, shape)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], event_type: pa.DataType) -> pa.RecordBatch:
    names = ["correlation", "rule_name", "group_key", "is_state", "start", "t", "event_id", "n"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), event_type, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def alerts_of(folded: DataFrame) -> DataFrame:
    """correlation, rule_name, group_key, window_start, alert_ts, event_id, n."""
    return folded.where(~F.col("is_state")).select("correlation", "rule_name", "group_key", F.timestamp_micros("start").alias("window_start"), F.timestamp_micros("t").alias("alert_ts"), "event_id", "n")


def fold_alerts(counted: DataFrame) -> DataFrame:
    """Triggers to alerts."""
    return alerts_of(fold_windows(counted))


def correlate(events: DataFrame, ruleset: Ruleset, fields: dict[str, Column], key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Alerts over a batch of evaluated events."""
    return fold_alerts(triggers(events, ruleset, fields, key, ts))


def distinct_values(events: DataFrame, ruleset: Ruleset, fields: dict[str, Column], ts: str = "ts") -> DataFrame:
    """The rule standard's value_count over fixed windows: distinct values of the counted field by group."""
    out = None
    for i, c in enumerate(ruleset.correlations):
        ids = rule_ids(ruleset, c)
        if not ids or c.vc_gte is None or not c.timespan_s or c.vc_field not in fields:
            continue
        own = events.where(F.exists("matched", lambda m: m.isin(ids)))
        w = F.window(F.col(ts), f"{int(c.timespan_s * 1e6)} microseconds")
        one = own.select(w.alias("w"), group_label(c, fields).alias("group_key"), fields[c.vc_field].alias("v")).groupBy("w", "group_key").agg(F.count_distinct("v").alias("n")).where(F.col("n") >= c.vc_gte)
        one = one.select(F.lit(i).alias("correlation"), F.lit(c.name).alias("rule_name"), "group_key", F.col("w.start").alias("window_start"), "n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else events.sparkSession.createDataFrame([], "correlation int, rule_name string, group_key string, window_start timestamp, n long")


def windows_per_rule(counted: DataFrame) -> DataFrame:
    """Groups with a window, by rule."""
    return counted.groupBy("rule_name").agg(F.count_distinct("group_key").alias("windows"))


def alert_rows(alerts: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Alerts as detections: rule number 0, confidence 0.9."""
    table = [(i, c.name, c.title or c.name, c.level or "medium") for i, c in enumerate(ruleset.correlations)]
    meta = alerts.sparkSession.createDataFrame(table, "correlation int, _n string, title string, level string")
    return alerts.join(meta, "correlation", "left").select(F.col("alert_ts").alias("occurred_at"), F.lit(0).alias("rule_id"), F.coalesce("title", "rule_name").alias("rule_name"), F.coalesce("level", F.lit("medium")).alias("severity"), F.lit(0.9).alias("confidence"), "group_key", "event_id", "n")
