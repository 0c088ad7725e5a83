"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

A document's set holds the hashes of its distinct shingles; documents with equal sets are one *node*.
Of every node BANDS x ROWS minima are taken; nodes that agree in a whole band meet in a bucket.

No bucket is ever expanded into all its pairs:
* *Stars.*  Each node is compared with the smallest node of each of its buckets; by the minima, the most
  promising is chosen and verified on full sets.  That gives first components.
* *The rest.*  A bucket whose nodes are all in one component has nothing left to find.  In the others, nodes
  outside the bucket's largest component meet every node of the bucket, in a grid of blocks: both sides are
  cut, so a task holds at most a block of either whatever the bucket's size.  A first pass over the minima alone tells
  which nodes of a block have a promising partner in another component; only these come with their texts to
  the second, which verifies on full sets, in the first band that a pair shares.  So every pair of a bucket is in one
  component or was tested.
Links are confirmed on the words themselves: 100 * intersection >= threshold * union.

A pair at the threshold 0.8 misses all 32 bands of 5 minima with probability 3e-6, and falls below the
agreement asked for (0.64 of 160 minima) with about 1e-6.

Defined results: null and empty texts have an empty set, link with nothing, and stay; a text with fewer
words than a shingle has itself as its one shingle; copies link whatever their number; component_id is the
smallest doc_id of the component, and rows without a doc_id don't lend theirs; a repeated doc_id
counts as its rows' common name (kept holds for each of them; ``first_of_each`` decides by row); an empty table gives no
rows; extra columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components, partial_labels
from .words import LOWER, U, Words, chunks, mix

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Share of equal minima from which a pair is verified.
AGREE = 0.64
#: Nodes of one side of a block (on average), and their bytes.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Shingles that a task holds unpacked.
LIVE = 200_000

_RNG = np.random.RandomState(11)
_A = (_RNG.randint(0, 1 << 62, HASHES).astype(U) << U(1)) | U(1)
_B = _RNG.randint(0, 1 << 62, HASHES).astype(U)

SIGNED = "set_key binary, n_shingles long, minima binary, ztext binary"


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, and their owners; a shorter text is one run."""
    n = w.counts()
    h = w.hash
    total = len(h)
    acc = np.zeros(max(0, total - size + 1), U)
    for j in range(size):
        acc = mix(acc * U(0x9FB21C651E98DF25) + h[j : j + len(acc)])
    doc = np.repeat(np.arange(len(n)), n)
    ok = doc[: len(acc)] == doc[size - 1 :] if len(acc) else np.zeros(0, bool)
    runs, owner = acc[ok], doc[: len(acc)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = []
        for d in short.tolist():
            x = U(0)
            with np.errstate(over="ignore"):
                for y in h[w.first[d] : w.first[d + 1]]:
                    x = mix(np.array([x * U(0x9FB21C651E98DF25) + y + U(1)], U))[0]
            extra.append(x)
        runs, owner = np.concatenate((runs, np.array(extra, U))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        runs, owner = runs[order], owner[order]
    return runs, owner


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of every hash (a * x + b, upper half) over a set."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 2048):
        part = ((_A[:, None] * s[None, k : k + 2048] + _B[:, None]) >> U(32)).min(axis=1)
        out = np.minimum(out, part.astype(np.uint32))
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            seen: set[bytes] = set()
            known: dict[str | None, tuple[bytes, int]] = {}
            ids, texts = b.column(0), b.column(1).to_pylist()
            fresh = list(dict.fromkeys(texts))
            new: dict[str | None, tuple[bytes, bytes]] = {}
            for start, part in chunks(fresh):
                w = Words(part, LOWER)
                runs, owner = shingle_hashes(w, size)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                for i, raw in enumerate(part):
                    s = np.unique(runs[cuts[i] : cuts[i + 1]])
                    key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""
                    known[fresh[start + i]] = (key, len(s))
                    if len(s) and key not in seen:
                        seen.add(key)
                        new[fresh[start + i]] = (minima(s).tobytes(), z.compress(raw))
            for k in range(0, b.num_rows, 1024):
                part_texts = texts[k : k + 1024]
                key, n = zip(*(known[t] for t in part_texts), strict=True)
                first = [new.pop(t, (None, None)) for t in part_texts]
                yield pa.RecordBatch.from_arrays([ids.slice(k, 1024), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array([x[0] for x in first], pa.binary()), pa.array([x[1] for x in first], pa.binary())], names=["row_key", "set_key", "n_shingles", "minima", "ztext"])

    return run


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """rows(row_key, text) to row_key, the set's key and size; minima and packed text with its first row in an Arrow batch."""
    schema = T.StructType([rows.schema["row_key"], *T.StructType.fromDDL(SIGNED).fields])
    return shared.mapped(rows.select("row_key", "text"), _sign(size), schema)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, band number, set_key) of every node; the number is hashed into the key."""
    salt = mix(np.arange(1, BANDS + 1).astype(U))
    for b in batches:
        for k in range(0, b.num_rows, 4096):
            part = b.slice(k, 4096)
            m = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(U)
            h = np.broadcast_to(salt, m.shape[:2]).copy()
            for r in range(ROWS):
                h = mix(h * U(0x9FB21C651E98DF25) + m[:, :, r])
            keys = part.column(0).to_pylist()
            which = np.tile(np.arange(BANDS, dtype=np.int8), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(which), pa.array([x for x in keys for _ in range(BANDS)], pa.binary()), pa.array(np.repeat(part.column(2).to_numpy(), BANDS))], names=["band", "which", "node", "zlen"])


def shingle_set(raw: bytes, size: int) -> set:
    w = raw.lower().split()  # bytes: A-Z only, and the six white-space bytes
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


class _Sets:
    """Shingle sets by key, LIVE shingles and the two sets in use at most; the oldest go first and are made again if asked for."""

    def __init__(self, size: int):
        self.size, self.z, self.held, self.total = size, zstandard.ZstdDecompressor(), {}, 0

    def get(self, key: bytes, packed: bytes) -> set:
        s = self.held.get(key)
        if s is None:
            s = self.held[key] = shingle_set(self.z.decompress(packed), self.size)
            self.total += len(s)
            while self.total > LIVE and len(self.held) > 2:
                self.total -= len(self.held.pop(next(iter(self.held))))
        return s


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for b in batches:
            u, v = [], []
            for x, y, p, q in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                s, t = sets.get(x, p.as_py()), sets.get(y, q.as_py())
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal minima of a node and a star's centre."""
    for b in batches:
        m, c = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, HASHES) for x in (b.column(2), b.column(3)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((m == c).sum(axis=1).astype(np.int32))], names=["node", "centre", "agree"])


def _promising(key, table):
    """The nodes of a block that have a partner on the other side: of another component, with enough equal minima, first met in this band."""
    place = table.column("place").to_numpy()
    comp = table.column("comp").to_pylist()
    names = {c: i for i, c in enumerate(dict.fromkeys(comp))}
    cid = np.array([names[c] for c in comp])
    m = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES)
    outside, inside = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
    which = table.column("which")[0].as_py()
    low, byband = m.astype(np.uint8), m.reshape(-1, BANDS, ROWS)
    theirs, of = np.ascontiguousarray(low[inside]), cid[inside]
    found = np.zeros(len(place), bool)
    for i in outside.tolist():
        # the last byte of each hash first: it never agrees less often than the whole
        near = np.flatnonzero((of != cid[i]) & ((theirs == low[i]).sum(axis=1) >= AGREE * HASHES))
        if not len(near):
            continue
        near = inside[near]
        near = near[(m[near] == m[i]).sum(axis=1) >= AGREE * HASHES]
        near = near[(byband[near] == byband[i]).all(axis=2).argmax(axis=1) == which]
        if len(near):
            found[i] = True
            found[near] = True
    return table.select(["band", "i", "j", "which", "node", "comp", "place"]).filter(pa.array(found))


def _rest(size: int, percent: int):
    """Links of one block: its nodes against those of the bucket that are outside the largest component.

    The most promising pairs come first, and what they join isn't tested again, so at most one link for
    each component of the block is given, and a group of any size gives few rows.
    """

    def run(key, table):
        place = table.column("place").to_numpy()
        node, comp, packed = (table.column(c).to_pylist() for c in ("node", "comp", "ztext"))
        m = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES)
        names = {c: i for i, c in enumerate(dict.fromkeys(comp))}
        cid = np.array([names[c] for c in comp])
        label = np.arange(len(names))  # of components; changes as links join them
        outside, inside = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        which = table.column("which")[0].as_py()
        mi, byband = m[inside], m.reshape(-1, BANDS, ROWS)
        sets = _Sets(size)
        u, v = [], []
        for i in outside.tolist():
            agree = (mi == m[i]).sum(axis=1)
            near = np.flatnonzero((agree >= AGREE * HASHES) & (label[cid[inside]] != label[cid[i]]))
            for j in near[np.argsort(-agree[near], kind="stable")].tolist():
                j = int(inside[j])
                if label[cid[i]] == label[cid[j]]:
                    continue
                if np.flatnonzero((byband[i] == byband[j]).all(axis=1))[0] != which:
                    continue  # tested in the first band that the two share
                s, t = sets.get(node[i], packed[i]), sets.get(node[j], packed[j])
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    u.append(node[i])
                    v.append(node[j])
                    label[label == label[cid[j]]] = label[cid[i]]
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return run


def deal(labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to the blocks (i, j) of a grid.

    Nodes outside the bucket's largest component (place -1) are cut into rows i, all nodes (place 0) into
    columns j; every outside node meets every node in exactly one block, and neither side of a block grows with the bucket.
    """
    most = F.max(F.struct("n", "bytes", "comp"))
    open_buckets = groups.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), most.alias("most")).where(F.col("c") > 1)
    cuts = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    columns, rows = cuts(F.col("n"), F.col("bytes")), cuts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    left = labelled.join(open_buckets.select("band", columns.alias("columns"), rows.alias("rows"), F.col("most.comp").alias("most")), "band")
    to = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = left.withColumn("j", to("columns", 1)).withColumn("i", every("rows")).withColumn("place", F.lit(0))
    outside = left.where(F.col("comp") != F.col("most")).withColumn("i", to("rows", 2)).withColumn("j", every("columns")).withColumn("place", F.lit(-1))
    return own.unionByName(outside).select("band", "i", "j", "which", "node", "comp", "place")


def linked_sets(signed: DataFrame, size: int, percent: int, work: shared.Workspace) -> DataFrame:
    """signed rows to (node, root) of all sets that link with another."""
    full = signed.where(F.col("minima").isNotNull())
    nodes = work.keep(full.select("set_key", "minima", F.length("ztext").alias("zlen")).dropDuplicates(["set_key"]))
    banded = shared.mapped(nodes, _bands, "band long, which tinyint, node binary, zlen int")
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where(F.col("n") > 1)
    members = work.keep(banded.join(sizes.select("band", "centre"), "band").select("band", "which", "node", "zlen", "centre"))
    near = members.select("node").distinct()
    texts = work.keep(full.select("set_key", "ztext").join(near.withColumnRenamed("node", "set_key"), "set_key", "left_semi").dropDuplicates(["set_key"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("set_key").alias("u"), F.col("ztext").alias("tu"))
        b = texts.select(F.col("set_key").alias("v"), F.col("ztext").alias("tv"))
        return shared.mapped(pairs.join(a, "u").join(b, "v").select("u", "v", "tu", "tv"), _verify(size, percent), "u binary, v binary")

    stars = members.where(F.col("node") != F.col("centre")).select("node", "centre").distinct()
    mine = nodes.select(F.col("set_key").alias("node"), F.col("minima").alias("m"))
    theirs = nodes.select(F.col("set_key").alias("centre"), F.col("minima").alias("c"))
    judged = shared.mapped(stars.join(mine, "node").join(theirs, "centre").select("node", "centre", "m", "c"), _agreement, "node binary, centre binary, agree int")
    best = judged.where(F.col("agree") >= AGREE * HASHES).groupBy("node").agg(F.max(F.struct("agree", "centre")).alias("b")).select(F.col("node").alias("u"), F.col("b.centre").alias("v"))
    links = work.keep(confirmed(best))
    # labels that only serve to leave out tests needn't be final
    joined = partial_labels(links, work, 2)
    first = joined.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    # buckets that still hold several components
    labelled = work.keep(members.join(first, "node", "left").select("band", "which", "node", "zlen", F.coalesce("root", "node").alias("comp")))
    groups = labelled.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("zlen") + F.lit(4 * HASHES)).alias("bytes"))
    dealt = deal(labelled, groups).join(nodes.select(F.col("set_key").alias("node"), "minima"), "node")
    marked = work.keep(dealt.groupBy("band", "i", "j").applyInArrow(shared.grouped(_promising), "band long, i int, j int, which tinyint, node binary, comp binary, place int"))
    payload = nodes.select(F.col("set_key").alias("node"), "minima").join(texts.withColumnRenamed("set_key", "node"), "node")
    doubtful = marked.join(payload, "node").select("band", "i", "j", "which", "node", "comp", "minima", "ztext", "place")
    more = work.keep(doubtful.groupBy("band", "i", "j").applyInArrow(shared.grouped(_rest(size, percent)), "u binary, v binary").distinct())
    roots = work.keep(components(joined.unionByName(more), work))
    for used in (nodes, members, texts, links, joined, labelled, marked, more):
        work.drop(used)
    return roots


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, name: str = "minhash") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    work = shared.Workspace(docs.sparkSession, name)
    signed = work.keep(signatures(docs.select(docs["doc_id"].alias("row_key"), docs["text"].alias("text")), size))
    roots = linked_sets(signed, size, percent, work)
    rows = work.keep(signed.select(F.col("row_key").alias("doc_id"), "set_key", "n_shingles"))
    work.drop(signed)
    # from sets to components, not from rows: copies are one set, and the join on the root is of two tables that Spark may split
    least = rows.where(F.col("n_shingles") > 0).groupBy("set_key").agg(F.min("doc_id").alias("m"))
    rooted = work.keep(least.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"), "m"))
    names = work.keep(rooted.groupBy("root").agg(F.min("m").alias("component_id")))
    linked = work.keep(rooted.join(names, "root").select("set_key", F.col("component_id").alias("_c")))
    found = rows.join(linked, "set_key", "left")
    out = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def row_keys(docs: DataFrame) -> Column:
    """A digest of a row's doc_id and text; a null text counts as empty."""
    d = docs["doc_id"].cast("string")
    head = F.concat(F.coalesce(F.length(d).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(d, F.lit("")), F.lit(":"))
    return F.unhex(F.sha2(F.concat(head, F.coalesce(docs["text"], F.lit(""))), 256))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, name: str = "minhash") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near duplicates stays: that of the smallest doc_id.

    Decided by row, so a repeated doc_id costs no other text: rows without a doc_id come last in a group, of equal
    doc_ids the smallest digest stays, and of rows equal in doc_id and text any one.  Rows without words all stay.
    """
    work = shared.Workspace(docs.sparkSession, name)
    signed = work.keep(signatures(docs.select(F.struct(docs["doc_id"].alias("id"), row_keys(docs).alias("row")).alias("row_key"), docs["text"].alias("text")), size))
    roots = linked_sets(signed, size, percent, work)
    rows = signed.where(F.col("n_shingles") > 0).groupBy("row_key.id", "row_key.row", "set_key").agg(F.count(F.lit(1)).alias("n"))
    rooted = work.keep(rows.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("id", "row", "n", F.coalesce("root", "set_key").alias("root")))
    work.drop(signed)
    winners = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("w")).select(F.col("w.row").alias("row"), F.lit(True).alias("won"))
    told = rooted.join(winners, "row", "left").where(F.col("won").isNull() | (F.col("n") > 1))
    verdict = work.keep(told.select("row", F.coalesce("won", F.lit(False)).alias("won")).distinct())
    own = docs.columns
    keyed = docs.select(row_keys(docs).alias("row"), *[docs[c].alias(f"c{i}") for i, c in enumerate(own)])
    out = keyed.join(verdict, "row", "left_anti").select(*[f"c{i}" for i in range(len(own))])
    repeated = verdict.where("won")
    if not repeated.isEmpty():
        once = keyed.join(repeated, "row", "left_semi").groupBy("row").agg(F.first(F.struct(*[f"c{i}" for i in range(len(own))])).alias("r"))
        out = out.unionByName(once.select(*[F.col(f"r.c{i}").alias(f"c{i}") for i in range(len(own))]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
