"""Rules over a stream of raw events, written to tables in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import Engine
from ..operators.ingest import ingest_batch
from ..sources.store import Store


def read_ndjson(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of JSON files as they arrive, as raw text."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "event")


def evaluate_stream(events: DataFrame, engine: Engine) -> DataFrame:
    """Stateless: the same columns and the same plan as over a batch."""
    return engine.evaluate(events)


def ingest(events: DataFrame, engine_of: Callable[[], Engine], store: Store, checkpoint: str, trigger: dict | None = None):
    """Starts a query that stores events, links, detections, correlation windows and endpoints.

    ``engine_of`` is asked for each micro-batch, so a replaced ruleset is in force from the next one on.
    A micro-batch that is written again (after a failure) replaces its earlier rows: tables are keyed by its number.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(store, engine_of(), batch, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
