"""Contiguous shards of near equal bytes, by DataFrame operations only.

Rows are ordered by (doc_id, text_crc32, size) and dealt into ranges; each range's total of bytes and
rows gives the range's place in the global prefix sums; inside a range a running sum completes them.
A row goes to the shard in which the middle of its bytes lies, so every shard is contiguous in the
order and its bytes differ from an equal share by at most one row's size.

No text is shuffled: only (doc_id, size, crc).  The ranges are written once, because where a range
ends depends on a sample and must not change between the totals and the running sums.

Defined results: null texts have size 16 and the CRC of no bytes; null doc_ids come first; rows equal
in all three columns are interchangeable; with no rows there is nothing to return; a row larger than a
shard's share takes one shard and neighbours may stay empty; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Bytes counted for each row beside its text.
ROW_BYTES = 16


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"], (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def prefix_sums(rows: DataFrame, order: list[str], size: str, work: shared.Workspace) -> DataFrame:
    """Adds ``before`` (bytes of all earlier rows), ``place`` (their number) and ``total``."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shared.partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    kept = work.keep(ranged)
    totals = kept.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # One row a range: this window's only partition is as long as the number of ranges.
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("_range", F.coalesce(F.sum("_bytes").over(so_far), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_rows").over(so_far), F.lit(0)).alias("_r0"), F.sum("_bytes").over(whole).alias("total"))
    within = Window.partitionBy("_range").orderBy(*order)
    local = kept.withColumn("_n", F.row_number().over(within)).withColumn("_s", F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return local.join(starts, "_range").select(*rows.columns, (F.col("_b0") + F.col("_s") - F.col(size)).alias("before"), (F.col("_r0") + F.col("_n") - 1).cast("long").alias("place"), "total")


def shard_by_bytes(docs: DataFrame, shards: int, name: str = "shards") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    work = shared.Workspace(docs.sparkSession, name)
    order = ["doc_id", "text_crc32", "size"]
    # the shard of the middle of a row's bytes; bigint holds the product up to 10**17 bytes and 40 shards
    placed = work.keep(prefix_sums(sized(docs), order, "size", work).withColumn("shard", F.least(F.expr(f"(2 * before + size) * {shards} div (2 * total)"), F.lit(shards - 1)).cast("int")))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("_first"))  # as many rows as shards
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
