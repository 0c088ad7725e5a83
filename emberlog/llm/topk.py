"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks; every block of queries meets every block of candidates in an equi-join
on the candidate block's number, so neither side is broadcast and no task holds more than one block of
each.  A pass scores everything and keeps, of each query, only a histogram over score bins; the global
sum of the histograms says in which bin the k-th value lies, and the next pass divides that bin.  When
the bins are one wide, the k-th value is known; a last pass keeps what reaches it, of ties the smaller
ids, at most k of a block, and a window over these few picks the k.

Within a block nothing below its own k-th bin is reported: the global k-th value can't lie lower, so a
pass emits at most k rows of a query and block.

Defined results: vec_id is the key of a query, and a row is never its own candidate, nor are other rows
of the same id; where a query's id is repeated, the smallest vector stands for it.  Rows with a null
id, a null vector, null or non-finite components have no part.  Vectors are compared with those of their own
length only, so every length is searched, each by itself; empty vectors score 0 with each other.  Fewer candidates than k: all of them.  No queries or no
candidates: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

SCALE = 1024
#: Rows of a block of candidates and of a block of queries.
ROWS, QUERIES = 4096, 1024
#: Bins that a pass divides a query's range of scores into.
BINS = 1024
#: Floats hold sums of products exactly below this.
EXACT = 1 << 53


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and its vector of integers floor(scale * x); rows that can't take part go."""
    x = F.col("embedding")
    ok = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].alias("embedding")).where(ok).select("vec_id", ints.alias("v"))


def lengths(vectors: DataFrame, rows: int) -> DataFrame:
    """d, count: each length and its number of blocks; a row of each length only."""
    return vectors.groupBy(F.size("v").alias("d")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("count"))


def blocks(vectors: DataFrame, rows: int, number: str) -> DataFrame:
    """Packs vectors of a length into blocks by a hash of the id and the vector: length, block number, ids and values as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []
        current, k = (0, 0), 0

        def out() -> Iterator[pa.RecordBatch]:
            i, v = np.concatenate(ids), np.concatenate(values)
            for s in range(0, len(i), 2 * rows):  # a block that many equal rows fell into is given in parts
                yield pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int32()), pa.array([s // (2 * rows)], pa.int32()), pa.array([i[s : s + 2 * rows].tobytes()], pa.binary()), pa.array([v[s : s + 2 * rows].tobytes()], pa.binary())], names=["d", number, "part", "ids", "vals"])

        for b in batches:
            d, blk = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(d, dtype=np.int64)])
            own = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero((d[1:] != d[:-1]) | (blk[1:] != blk[:-1])) + 1), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if ids and ((d[s], blk[s]) != current or k >= 2 * rows):
                    yield from out()
                    ids, values, k = [], [], 0
                current = (int(d[s]), int(blk[s]))
                ids.append(own[s:e])
                values.append(flat[at[s] : at[e]].reshape(e - s, d[s]))
                k += e - s
        if ids:
            yield from out()

    counted = vectors.withColumn("d", F.size("v")).join(F.broadcast(lengths(vectors, rows)), "d")
    spread = counted.select("d", F.pmod(F.xxhash64("vec_id", "v"), F.col("count")).cast("int").alias(number), "vec_id", "v")
    packed = spread.repartition("d", number).sortWithinPartitions("d", number).mapInArrow(pack, f"d int, {number} int, part int, ids binary, vals binary")
    # numbers of parts of one block must differ
    return packed.select("d", number, F.monotonically_increasing_id().alias("part"), "ids", "vals")


def _unpack(ids: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vals, np.int64).reshape(len(i), -1)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integers as int64; values beyond 2**62 are held there."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if high < EXACT:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if high < 2**62:
        return q @ c.T
    big = q.astype(object) @ c.T.astype(object)
    return np.clip(big, -(2**62), 2**62).astype(np.int64)


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    n = x.shape[1]
    return x.min(axis=1) if n <= k else np.partition(x, n - k, axis=1)[:, n - k]


def _histograms(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                qi, q = _unpack(row["q_ids"], row["q_vals"])
                ci, c = _unpack(row["ids"], row["vals"])
                lo, step = (np.array(row[x], np.int64) for x in ("lo", "step"))
                s = scores(q, c)
                bins = np.minimum((s - lo[:, None]) // step[:, None], BINS)  # all above the range in one
                bins[(s < lo[:, None]) | (qi[:, None] == ci[None, :])] = -1
                floor = np.maximum(_kth_largest(bins, k), 0)
                at = np.nonzero((bins >= floor[:, None]))
                pair, n = np.unique(at[0] * (BINS + 1) + bins[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(qi[pair // (BINS + 1)]), pa.array((pair % (BINS + 1)).astype(np.int32)), pa.array(n, pa.int64())], names=["query_id", "bin", "n"])

    return run


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            qi, q = _unpack(row["q_ids"], row["q_vals"])
            _, c = _unpack(row["ids"], row["vals"])
            s = scores(q, c)
            yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(s.min(axis=1)), pa.array(s.max(axis=1))], names=["query_id", "low", "high"])


def _last(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                qi, q = _unpack(row["q_ids"], row["q_vals"])
                ci, c = _unpack(row["ids"], row["vals"])
                lo = np.array(row["lo"], np.int64)
                order = np.argsort(ci, kind="stable")
                ci, s = ci[order], scores(q, c)[:, order]
                qs, cs, got = [], [], []
                for i in range(len(qi)):
                    found = np.flatnonzero((s[i] >= lo[i]) & (ci != qi[i]))
                    best = found[np.argsort(-s[i, found], kind="stable")[:k]]
                    qs.append(np.full(len(best), qi[i]))
                    cs.append(ci[best])
                    got.append(s[i, best])
                cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([cat(qs), cat(cs), cat(got)], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, k: int, is_query, name: str = "topk") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which ``is_query`` (a Column on vec_id) holds."""
    spark = rows.sparkSession
    work = shared.Workspace(spark, name)
    vectors = work.keep(whole_vectors(rows))
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    if queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cands = work.keep(blocks(vectors, ROWS, "cblock"))
    n_cblocks = work.keep(lengths(vectors, ROWS))
    qs = work.keep(blocks(queries, QUERIES, "qblock").select("d", "qblock", F.col("part").alias("qpart"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals")))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, part, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                i = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(i), pa.int64()), pa.array(range(len(i)), pa.int32()), pa.array(i)], names=["qpart", "pos", "query_id"])

    places = work.keep(qs.select("qblock", "qpart", "q_ids").mapInArrow(ids_of, "qpart long, pos int, query_id long"))

    def meet(state: DataFrame | None) -> DataFrame:
        """Every block of queries with every block of candidates of its length, by the candidate block's number."""
        q = qs
        if state is not None:
            packed = places.join(state, "query_id").groupBy("qpart").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "step"))).alias("s"))  # bounded by a block
            q = qs.join(packed, "qpart").select("d", "qpart", "q_ids", "q_vals", F.col("s.lo").alias("lo"), F.col("s.step").alias("step"))
        q = q.join(F.broadcast(n_cblocks), "d").withColumn("cblock", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).drop("count")
        return cands.select("d", "cblock", "ids", "vals").join(q, ["d", "cblock"])

    ranged = meet(None).select("q_ids", "q_vals", "ids", "vals").mapInArrow(_extremes, "query_id long, low long, high long").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    step = F.greatest(F.ceil((F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1) / F.lit(BINS)).cast("long"), F.lit(1))
    state = work.keep(ranged.select("query_id", F.col("low").alias("lo"), step.alias("step"), F.lit(k).cast("long").alias("need")))
    while True:
        hist = meet(state).select("q_ids", "q_vals", "ids", "vals", "lo", "step").mapInArrow(_histograms(k), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        # the highest bin down to which k scores are counted; with fewer scores the range's start stays
        found = hist.withColumn("c", above).where(F.col("c") >= k).groupBy("query_id").agg(F.max("bin").alias("bin"))
        lo = F.col("lo") + F.col("bin") * F.col("step")
        new = state.join(found, "query_id", "left").select("query_id", F.coalesce(lo, F.col("lo")).alias("lo"), F.when(F.col("bin").isNull(), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("step") / F.lit(BINS)), F.lit(1))).cast("long").alias("step"), F.when(F.col("bin").isNull() | (F.col("step") == 1), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("need"))
        state = work.keep(new)
        if not state.agg(F.max("need")).first()[0]:
            break
    hits = meet(state).select("q_ids", "q_vals", "ids", "vals", "lo").mapInArrow(_last(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
