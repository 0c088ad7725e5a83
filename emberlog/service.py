"""The service's calls as functions over tables: each returns a DataFrame or a dict."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import JsonEvents, process_columns
from .functions.registry import Registry
from .operators import proctree, views
from .operators.detect import Engine, enriched, rule_table
from .operators.ingest import ingest_batch
from .plans.compiler import compile_rules
from .plans.ir import EngineConfig, Ruleset
from .sources import feeds
from .sources.store import Store

#: Entries that a report lists of each kind; it says how many more there are.
LISTED = 1000


class Service:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None, registry: Registry | None = None):
        self.spark, self.store = spark, Store(spark, root)
        self.config, self.registry = config, registry
        self.engine = Engine(Ruleset(), JsonEvents(), config, registry)

    def health(self) -> dict:
        return {"status": "ok"}

    def load(self, ruleset: Ruleset) -> Engine:
        """Puts a ruleset in force and stores its metadata."""
        self.engine = Engine(ruleset, JsonEvents(), self.config, self.registry)
        if ruleset.rules:
            self.store.put_batch("rules", rule_table(self.spark, ruleset).withColumn("created_at", F.current_timestamp()), time.time_ns())
        return self.engine

    def replace_rules(self, texts: list[str]) -> int:
        """All or nothing: the first bad rule raises, and the old ruleset stays in force."""
        return self.load(compile_rules(texts)).rule_count()

    def ingest(self, payloads: DataFrame, batch: int | None = None) -> dict[str, DataFrame]:
        """Bodies (column ``payload``) to stored events, detections, links, alerts and endpoints.

        Batches are numbered rising; correlation windows go on from one call to the next.
        """
        events = feeds.parse_payloads(payloads).where(F.col("event").isNotNull()).select("event")
        return ingest_batch(self.store, self.engine, events, time.time_ns() if batch is None else batch)

    def evaluate_raw(self, events: DataFrame) -> DataFrame:
        """Raw texts (column ``event``) with ``matched``, or an error where a text is no JSON."""
        bad = F.try_parse_json("event").isNull()
        return self.engine.evaluate(events).withColumn("error", F.when(bad, F.lit("invalid JSON"))).withColumn("matched", F.when(~bad, F.col("matched")))

    def stats(self) -> dict:
        return {"rules": self.store.read("rules").count(), "endpoints": self.store.read("endpoints").count(), "events": self.store.read("events").count(), "detections": self.store.read("detections").count()}

    def endpoints(self) -> DataFrame:
        return views.newest_endpoints(self.store.read("endpoints"))

    def detections(self, limit: int | None = None) -> DataFrame:
        """Newest first, with what is known of their rules."""
        return enriched(self.store.read("detections"), self.store.read("rules")).orderBy(F.desc("occurred_at"), F.desc("event_id"), "rule_id").limit(views.clamp(limit, 200, 1000))

    def rules(self, limit: int | None = None) -> DataFrame:
        found = self.store.read("detections").join(self.store.read("rules").select("rule_id", "rule_uid"), "rule_id")
        return views.rules_with_counts(self.store.read("rules"), found, limit)

    def process_nodes(self, as_of=None) -> DataFrame:
        e = self.store.read("events")
        rows = e.select("event_id", "received_at", *[c.alias(n) for n, c in process_columns(JsonEvents()).items() if n != "endpoint_id"], "endpoint_id").withColumn("ts", F.coalesce("ts", "received_at"))
        return proctree.build_nodes(rows.withColumn("seq", F.struct("ts", "event_id")), F.current_timestamp() if as_of is None else as_of)

    def process_tree(self, endpoint: str, key: str | None = None) -> DataFrame:
        return proctree.snapshot(self.process_nodes(), endpoint, key)

    def analyze(self, endpoint: str) -> str:
        nodes = self.process_nodes().where(F.col("endpoint_id") == endpoint)
        row = proctree.analysis(nodes).first()
        if row is None:
            raise KeyError(endpoint)
        pairs, found = proctree.suspicious_pairs(nodes), proctree.anomalies(nodes)
        listed = (pairs.orderBy("key", "above", "exe", "description").limit(LISTED), found.orderBy(F.desc("n"), "executable").limit(LISTED))
        return proctree.report(row.asDict(), *[[r.asDict() for r in x.collect()] for x in listed], pairs.count(), found.count())

    def suspicious(self) -> DataFrame:
        return self.process_nodes().where("suspicious").orderBy(F.desc("last_seen"), "endpoint_id", "key")
