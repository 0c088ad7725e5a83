"""Substring dedup: repeated windows of words, counted exactly over super-k-mers.

A window is K consecutive words.  Its minimiser is the smallest hash among its runs of M words; consecutive
windows that share it form a super-k-mer, which travels to the minimiser's bucket as one packed string, so
equal windows always meet in one bucket, however they are embedded.  There the windows are sorted by hash,
neighbours compared word by word, and counted.

Three passes over the texts:
1. *frequent runs*: runs of M words that would load one bucket unevenly (a line that a third of all texts
   have).  These never serve as minimisers.  They are counted among the lower quarter of hashes, from which nearly all minimisers come;
   a window with none left there lies inside a hot passage, whose strings are equal and so travel once a batch.
2. *count*: distinct super-k-mers of each batch, once each with whether they occurred again, compressed by
   bucket.  A bucket answers with the covered stretches of each super-k-mer that has repeated windows.
3. *locate*: super-k-mers of each distinct text of a batch by a 128-bit hash, joined to the answers.
   This is an ordinary equi-join whose large keys Spark splits; copies in a batch are sent once, and what a bitset of the
   answers' hashes excludes isn't sent.
Last, texts that may have covered stretches (again by a bitset, of their digests) meet them in a join; all others are
finished where they stand.  Bitsets have a bounded size; where they fill up, more is sent and results stay.

Defined results: a null text has no words; texts of fewer than K words keep all of them; whole copies
lose every word that a window covers; a repeated row counts as another place; null or repeated doc_ids
change nothing, as nothing is keyed by them; very long texts are taken whole; an empty table gives no rows; a passed
column named like one of the results gives way to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .words import Spans, U, Words, chunks, mix, sliding_min

K, M = 35, 5
#: Packed bytes that a bucket should hold, and bytes of packed strings for a byte of text.
BUCKET_BYTES, EXPANSION = 6 << 20, 3.1
#: A run of windows is cut so that no packed string gets long.
RUN = 256
#: A run is counted from so many occurrences in a task's stretch of CHUNK_RUNS runs on; it is frequent from a share of a bucket.  One that
#: is rarer everywhere occurs sqrt(limit * stretches) times at most or so, which loads no bucket.
LOCAL, CHUNK_RUNS = 2, 1 << 23
#: Hashes up to which runs are counted.
UPPER = 1 << 62
#: Frequent runs that are broadcast at most (8 bytes each); further ones cost balance, not results.
FREQUENT = 1 << 20


#: Bits of a bitset at most: of one that is sent to the workers, and of one that is sent as a table (a row for 64).
MOST_BITS, MOST_ROW_BITS = 1 << 27, 1 << 25
#: Rows of a batch whose texts are held as objects at a time, and bytes of packed strings.
ROWS, HELD = 2048, 24 << 20


def text_key(b: bytes) -> tuple[int, int]:
    """The first 128 bits of a text's digest."""
    return struct.unpack(">qq", hashlib.sha256(b).digest()[:16])


def text_key_columns(text: Column) -> list[Column]:
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, k, 16), 16, -10).cast("long") for k in (1, 17)]


class Windows:
    """Super-k-mers of several texts."""

    def __init__(self, w: Words, frequent: np.ndarray):
        n = len(w.hash)
        self.start = self.stop = np.empty(0, np.int64)
        self.value = np.empty(0, U)
        if n < K:
            return
        spans = Spans(w.hash)
        at = np.arange(n - M + 1)
        runs = mix(spans.get(at, at + M, 0) ^ U(0xA5A5A5A5))
        if len(frequent):
            pos = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
            runs[frequent[pos] == runs] = U(0xFFFFFFFFFFFFFFFF)
        low = sliding_min(runs, K - M + 1)  # of window i, which starts at word i
        own = np.flatnonzero(low == U(0xFFFFFFFFFFFFFFFF))
        if len(own):
            low[own] = spans.get(own, own + K, 1)
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        ok = doc[: n - K + 1] == doc[K - 1 :]
        i = np.flatnonzero(ok)
        if not len(i):
            return
        new = np.ones(len(i), bool)
        new[1:] = (low[i[1:]] != low[i[:-1]]) | (i[1:] != i[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(i)))
        if size.max() > RUN:
            pieces = -(-size // RUN)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head, size = np.repeat(head, pieces) + k * RUN, np.minimum(np.repeat(size, pieces) - k * RUN, RUN)
        self.start = i[head]
        self.stop = self.start + size + K - 1  # words [start, stop)
        self.value = low[self.start]
        self.spans = spans

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return self.spans.get(self.start, self.stop, 0).view(np.int64), self.spans.get(self.start, self.stop, 1).view(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of M words that occur LOCAL times in a stretch of a task, with their counts; of the lower quarter of hashes, from which minimisers come."""
    found: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(found), return_counts=True)
        v, n = v[n >= LOCAL], n[n >= LOCAL]
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n, pa.int64())], names=["v", "n"])

    for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        for _, part in chunks(list(dict.fromkeys(b.column(0).to_pylist()))):
            w = Words(part)
            if len(w.hash) >= K:
                at = np.arange(len(w.hash) - M + 1)
                runs = mix(Spans(w.hash).get(at, at + M, 0) ^ U(0xA5A5A5A5))
                found.append(runs[runs < U(UPPER)])
                held += len(found[-1])
                if held >= CHUNK_RUNS:
                    yield out()
                    found, held = [], 0
    if found:
        yield out()


class Bits:
    """A set of 64-bit hashes by some of their bits: never misses a member; at most ``most`` bits, whatever the data."""

    def __init__(self, n: int, most: int):
        self.size = min(most, 1 << max(16, (16 * n).bit_length()))

    def words(self, hashes: DataFrame, column: str) -> DataFrame:
        """(w, bits): at most size / 64 rows."""
        slot = F.col(column).bitwiseAND(F.lit(self.size - 1))
        bit = F.expr("shiftleft(1L, cast(_s & 63 as int))")
        return hashes.select(slot.alias("_s")).select(F.shiftright("_s", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))

    def array(self, hashes: DataFrame, column: str) -> np.ndarray:
        found = self.words(hashes, column).toPandas()
        out = np.zeros(self.size // 64, U)
        out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(U)
        return out


def _member(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h.view(U) & U(64 * len(bits) - 1)
    return (bits[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == 1


def _pack(frequent, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, z = frequent.value, zstandard.ZstdCompressor(level=6)
        seen: dict[tuple[int, int], int] = {}
        packed: list[bytes] = []
        where: list[int] = []
        again: list[int] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            order = np.argsort(np.array(where, np.int64), kind="stable")
            by = np.array(where, np.int64)[order]
            cuts = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            rows = []
            for s, e in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
                rows.append(z.compress(b"\n".join(b"%d %s" % (again[i], packed[i]) for i in order[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array(by[cuts]), pa.array(rows, pa.binary())], names=["bucket", "packed"])

        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            copies: dict[str | None, int] = {}
            for t in b.column(0).to_pylist():
                copies[t] = copies.get(t, 0) + 1
            texts = list(copies)
            for first, part in chunks(texts):
                w = Words(part)
                sk = Windows(w, hot)
                h1, h2 = sk.keys()
                lengths = w.end - w.start
                # the words, one space between each two
                offset = np.concatenate(([0], np.cumsum(lengths + 1)))
                keep = np.zeros(len(w.buf) + 1, np.int8)
                np.add.at(keep, w.start, 1)
                np.add.at(keep, w.end + 1, -1)
                line = w.buf[np.cumsum(keep[:-1]) > 0].copy()
                line[offset[1:] - 1] = 32
                line = line.tobytes()
                doc = np.searchsorted(w.first, sk.start, side="right") - 1
                twice = [copies[texts[first + i]] > 1 for i in range(len(part))]
                bucket = (sk.value % U(buckets)).astype(np.int64)
                for a, c, x, y, k, d in zip(offset[sk.start].tolist(), (offset[sk.stop] - 1).tolist(), h1.tolist(), h2.tolist(), bucket.tolist(), doc.tolist(), strict=True):
                    at = seen.get((x, y))
                    if at is None:
                        seen[x, y] = len(packed)
                        packed.append(line[a:c])
                        where.append(k)
                        again.append(2 if twice[d] else 1)
                        held += c - a
                    else:
                        again[at] = 2
                if held > HELD:
                    yield from out()
                    seen, packed, where, again, held = {}, [], [], [], 0
        if packed:
            yield from out()

    return run


def _count(key, table):
    """A bucket's answers: hash of each super-k-mer with repeated windows, and the covered stretches in it."""
    z = zstandard.ZstdDecompressor()
    lines: list[bytes] = []
    for x in table.column("packed"):
        lines += z.decompress(x.as_py(), max_output_size=1 << 31).split(b"\n")
    times = np.array([x[0] - 48 for x in lines], np.int64)
    parts = [Words(part) for _, part in chunks([x[2:] for x in lines])]
    hashes = np.concatenate([p.hash for p in parts])
    first = np.concatenate(([0], np.cumsum(np.concatenate([p.counts() for p in parts]))))
    del parts
    spans = Spans(hashes)
    n = np.diff(first) - K + 1  # windows of each
    owner = np.repeat(np.arange(len(lines)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[owner] + inner
    h = spans.get(at, at + K, 0)
    order = np.argsort(h, kind="stable")
    hs, a = h[order], at[order]
    same = np.zeros(len(hs), bool)
    near = np.flatnonzero(hs[1:] == hs[:-1]) + 1
    equal = np.ones(len(near), bool)
    for j in range(K):
        equal &= hashes[a[near] + j] == hashes[a[near - 1] + j]
    same[near[equal]] = True
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weights=times[owner[order]]) if len(group) else np.empty(0)
    repeated = np.zeros(len(h), bool)
    repeated[order] = total[group] > 1
    hit = np.flatnonzero(repeated)
    k1, k2, ranges = [], [], []
    if len(hit):
        own, off = owner[hit], inner[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (own[1:] != own[:-1]) | (off[1:] > off[:-1] + K)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1
        lo, hi, who = off[head], off[tail] + K, own[head]
        cut = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        names = who[cut]
        k1 = spans.get(first[names], first[names + 1], 0).view(np.int64)
        k2 = spans.get(first[names], first[names + 1], 1).view(np.int64)
        flat = np.stack([lo, hi], 1)
        ranges = [flat[s:e].ravel().tolist() for s, e in zip(cut, np.append(cut[1:], len(who)), strict=True)]
        # a string that came from several batches has one answer
        _, once = np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)
        k1, k2, ranges = k1[once], k2[once], [ranges[i] for i in once.tolist()]
    return pa.table({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "ranges": pa.array(ranges, pa.list_(pa.int32()))})


def _locate(frequent, answered):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bits = frequent.value, answered.value
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for _, part in chunks(list(dict.fromkeys(b.column(0).to_pylist()))):
                w = Words(part)
                sk = Windows(w, hot)
                if not len(sk.start):
                    continue
                h1, h2 = sk.keys()
                hit = np.flatnonzero(_member(bits, h1))
                doc = np.searchsorted(w.first, sk.start[hit], side="right") - 1
                keys = np.zeros((len(part), 2), np.int64)
                for d in np.unique(doc).tolist():
                    keys[d] = text_key(part[d])
                yield pa.RecordBatch.from_arrays([pa.array(h1[hit]), pa.array(h2[hit]), pa.array(keys[doc, 0]), pa.array(keys[doc, 1]), pa.array((sk.start[hit] - w.first[doc]).astype(np.int32))], names=["k1", "k2", "t1", "t2", "pos"])

    return run


def covered(texts: DataFrame, work: shared.Workspace) -> DataFrame:
    """texts(text) to one row a text with repeated windows: t1, t2 (its key), ranges (flat pairs of word positions)."""
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shared.partitions(spark), int(n_bytes * EXPANSION / BUCKET_BYTES) + 1)
    # super-k-mers are about 16 windows, 100 bytes of text; a run that alone fills a quarter of a bucket is frequent
    limit = max(16, int(n_bytes / 100 / buckets / 4))
    counts = shared.mapped(texts.select("text"), _frequent, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= limit).orderBy(F.desc("n"), "v").limit(FREQUENT).select("v").toPandas()["v"]
    frequent = spark.sparkContext.broadcast(np.sort(top.to_numpy(np.int64).view(U)))
    packed = shared.mapped(texts.select("text"), _pack(frequent, buckets), "bucket long, packed binary")
    answers = work.keep(packed.groupBy("bucket").applyInArrow(shared.grouped(_count), "k1 long, k2 long, ranges array<int>"))
    answered = spark.sparkContext.broadcast(Bits(answers.count(), MOST_BITS).array(answers, "k1"))
    # a run cut at RUN may stand in several buckets' strings only if equal, hence once; long keys are split by Spark
    places = shared.mapped(texts.select("text"), _locate(frequent, answered), "k1 long, k2 long, t1 long, t2 long, pos int")
    hits = places.join(answers, ["k1", "k2"])
    flat = hits.select("t1", "t2", F.transform("ranges", lambda x: x + F.col("pos")).alias("r"))
    return work.keep(flat.groupBy("t1", "t2").agg(F.flatten(F.collect_set("r")).alias("ranges")))  # bounded by one text's length


def _keep_mask(n: int, ranges: list[int] | None) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    if ranges:
        r = np.array(ranges, np.int64)
        np.add.at(mark, r[0::2], 1)
        np.add.at(mark, r[1::2], -1)
    return np.cumsum(mark[:n]) == 0


RESULTS = ("n_words", "n_removed", "kept", "kept_sha256")


def remove_repeats(docs: DataFrame, columns: list[str], name: str = "substrings", results: tuple[str, ...] = RESULTS) -> DataFrame:
    """The named columns with n_words, n_removed, kept (the text left: words joined by one space, where words went; else unchanged) and its digest."""
    work = shared.Workspace(docs.sparkSession, name)
    columns = shared.passed(columns, list(results))
    own = [c for c in columns if c != "text"]
    rows = docs.select(docs["text"].alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(own)])
    ranges = covered(rows.select("text"), work)
    bits = Bits(ranges.count(), MOST_ROW_BITS)
    t1, t2 = text_key_columns(F.col("text"))
    keyed = rows.withColumn("t1", t1).withColumn("t2", t2)
    slot = F.col("t1").bitwiseAND(F.lit(bits.size - 1))
    marked = keyed.withColumn("_s", slot).withColumn("w", F.shiftright("_s", 6)).join(F.broadcast(bits.words(ranges, "t1")), "w", "left")
    maybe = F.coalesce(F.expr("shiftright(bits, cast(_s & 63 as int)) & 1L") == 1, F.lit(False))
    passed = [f"c{i}" for i in range(len(own))]
    some = marked.where(maybe).select(*passed, "text", "t1", "t2").join(ranges, ["t1", "t2"], "left").select(*passed, "text", "ranges")
    joined = some.unionByName(marked.where(~maybe).select(*passed, "text", F.lit(None).cast("array<int>").alias("ranges")))
    extra = [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*[T.StructField(c, docs.schema[o].dataType) for c, o in zip(passed, own, strict=True)], *extra])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                got = part.column(part.schema.get_field_index("ranges")).to_pylist()
                n, gone, kept, sha = [], [], [], []
                for t, r in zip(texts, got, strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    if r:
                        keep = _keep_mask(len(words), r)
                        left = [x for x, k in zip(words, keep.tolist(), strict=True) if k]
                    else:
                        left = words
                    joined_words = b" ".join(left)
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(joined_words.decode("utf-8", "surrogatepass") if len(left) < len(words) else t)
                    sha.append(hashlib.sha256(joined_words).hexdigest())
                cols = [part.column(part.schema.get_field_index(c)) for c in passed] + [part.column(part.schema.get_field_index("text"))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=[*passed, "text", "n_words", "n_removed", "kept", "kept_sha256"])

    out = shared.mapped(joined, rewrite, schema)
    return out.select(*[(F.col("text") if c == "text" else F.col(f"c{own.index(c)}")).alias(c) for c in columns], *[F.col(r).alias(x) for r, x in zip(RESULTS, results, strict=True)])
