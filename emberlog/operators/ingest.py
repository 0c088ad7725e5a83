"""One batch of raw events through the engine into the tables; the service's calls and streams are this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import endpoint_columns
from ..sources.store import Store, latest
from .correlate import alert_rows, alerts_of, fold_windows, triggers
from .detect import Engine, detections, event_rule_links, rule_table


def ingest_batch(store: Store, engine: Engine, events: DataFrame, batch: int) -> dict[str, DataFrame]:
    """Raw texts (column ``event``) to stored events, detections, links, correlation windows and endpoints.

    A batch that is written again replaces its earlier rows.  Events are stored first and read back, so their numbers are
    settled before anything refers to them.  Windows go on from the state that earlier batches left.
    """
    spark = events.sparkSession
    owner = {n: c.alias(n) for n, c in endpoint_columns(engine.fields).items()}
    numbered = events.select("event", F.current_timestamp().alias("received_at")).withColumn("event_id", F.xxhash64(F.lit(batch), F.monotonically_increasing_id()))
    store.put_batch("events", numbered.select("*", owner["endpoint_id"]), batch)
    stored = store.batch("events", batch)
    store.put_batch("endpoints", stored.select("received_at", *owner.values()).where(F.col("endpoint_id") != "").withColumnRenamed("received_at", "last_seen"), batch)
    seen = engine.evaluate(stored)
    rules = rule_table(spark, engine.ruleset)
    hits = seen.select("event_id", "endpoint_id", F.col("received_at").alias("occurred_at"), F.col("event").alias("context"), F.explode("matched").alias("rule_id"))
    found = detections(hits, rules).drop("rule_uid")
    if engine.ruleset.correlations:
        groups = {g: engine.fields.flat(g) for c in engine.ruleset.correlations for g in c.group_by}
        counted = triggers(seen.withColumn("ts", F.col("received_at")), engine.ruleset, groups)
        state = latest(store.all("windows").where(F.col("is_state") & (F.col("seq") < batch)).select(F.struct("rule_name", "group_key").alias("k"), "seq", "start", "n"), "k", "seq")
        store.put_batch("windows", fold_windows(counted, state.select("k.*", "start", "n")).withColumn("seq", F.lit(batch).cast("long")), batch)
        alerts = alert_rows(alerts_of(store.batch("windows", batch)), engine.ruleset)
        with_event = alerts.join(stored.select("event_id", "endpoint_id", F.col("event").alias("context")), "event_id")
        found = found.unionByName(with_event.select(*found.columns))
    store.put_batch("detections", found, batch)
    store.put_batch("event_rules", event_rule_links(hits, rules), batch)
    return {t: store.batch(t, batch) for t in ("events", "detections", "event_rules", "endpoints")}
