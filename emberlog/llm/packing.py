"""Variable-capacity best-fit packing: several permitted sequence lengths, optimised jointly.

Sequences of tokens (the bytes of texts, or ids of any tokenizer) are cut into pieces no longer than the largest
capacity (nothing is dropped), pieces are dealt into groups of bounded size, and each group is packed on its own by
best fit in order of falling length: a piece goes to the open bin with the least room that still holds it.  If there
is none, a bin is opened, of the size that costs least: for each permitted size that holds the piece, the room
is filled in thought with the largest pieces that are still to come, and the size with the least cost for a token stays (a bin
of capacity c costs c + OVERHEAD).  At the end every bin is downsized to the smallest capacity that holds its
contents.  Where opening one fixed size throughout happens to be cheaper for a whole group, that packing is taken.

A bin comes out as one row: its tokens end to end, and the pieces with the offsets at which positions start anew.

Groups have a bounded number of pieces and tokens whatever the table, and equal rows are spread like others; the waste
is at most the last bins of a group.  Pieces are written once before they are dealt, so that a task that
runs again finds the same ones.

Defined results: null and empty sequences have no piece but keep a row without a bin; equal pieces are
interchangeable; rows without a doc_id and repeated doc_ids are packed like others; an empty table gives no rows; doc_id
may be of any type, and other columns aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Permitted sequence lengths: of ids, and of bytes.
CAPACITIES = (256, 512, 1024, 2048, 4096)
BYTE_CAPACITIES = (1024, 2048, 4096, 8192, 16384)
OVERHEAD = 8
#: Pieces and tokens of a group (on average).
GROUP, GROUP_TOKENS = 20_000, 4 << 20


class Rooms:
    """Open bins by free room: the least room of at least n in a few bit operations."""

    def __init__(self, largest: int):
        self.stacks: list[list[int]] = [[] for _ in range(largest + 1)]
        self.mask = 0

    def put(self, room: int, number: int) -> None:
        if room > 0:
            self.stacks[room].append(number)
            self.mask |= 1 << room

    def take(self, least: int) -> tuple[int, int] | None:
        above = self.mask >> least
        if not above:
            return None
        room = least + (above & -above).bit_length() - 1
        number = self.stacks[room].pop()
        if not self.stacks[room]:
            self.mask ^= 1 << room
        return room, number


class Waiting:
    """Pieces still to be placed, counted by length."""

    def __init__(self, lengths: list[int], largest: int):
        self.count, self.mask = [0] * (largest + 1), 0
        for n in lengths:
            self.count[n] += 1
        for n in set(lengths):
            self.mask |= 1 << n

    def remove(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n

    def fill(self, room: int) -> int:
        """How much of a room the largest waiting pieces take, one after another."""
        mask, left = self.mask, room
        while left:
            below = mask & ((1 << (left + 1)) - 1)
            if not below:
                break
            n = below.bit_length() - 1
            left -= n * min(self.count[n], left // n)
            mask = below ^ (1 << n)
        return room - left


def _best_fit(lengths: list[int], capacities: tuple[int, ...], opening: int | None) -> tuple[list[int], list[int]]:
    """Bin of each piece (lengths fall) and the fill of each bin; ``opening``: the size to open, if it fits; None: the size of least cost."""
    rooms, where, fill = Rooms(capacities[-1]), [], []
    waiting = Waiting(lengths, capacities[-1]) if opening is None else None
    for n in lengths:
        if waiting:
            waiting.remove(n)
        found = rooms.take(n)
        if found is not None:
            room, number = found
        else:
            fit = [c for c in capacities if c >= n]
            if waiting:
                costs = []
                for c in fit:
                    full = n + waiting.fill(c - n)
                    costs.append(((next(x for x in fit if x >= full) + OVERHEAD) / full, c))
                room = min(costs)[1]
            else:
                room = opening if opening >= n else fit[0]
            number = len(fill)
            fill.append(0)
        fill[number] += n
        where.append(number)
        rooms.put(room - n, number)
    return where, fill


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of each piece and the capacity of each bin; lengths must fall and fit."""
    best = None
    for opening in (None, *capacities):
        where, fill = _best_fit(lengths, capacities, opening)
        sizes = [next(c for c in capacities if c >= f) for f in fill]
        cost = sum(sizes) + OVERHEAD * len(sizes)
        if best is None or cost < best[0]:
            best = (cost, where, sizes)
    return best[1], best[2]


def pieces(docs: DataFrame, tokens: Column, largest: int) -> DataFrame:
    """doc_id, piece, start, length, tokens of every piece; empty sequences: one row of length 0."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), tokens.alias("t"))
    binary = isinstance(rows.schema["t"].dataType, T.BinaryType)
    n = F.coalesce(F.octet_length("t") if binary else F.when(F.col("t").isNotNull(), F.size("t")), F.lit(0))
    empty = F.lit(b"") if binary else F.array().cast(rows.schema["t"].dataType)
    last = F.greatest(F.ceil(n / F.lit(largest)).cast("int") - 1, F.lit(0))
    part = lambda k: (F.substring if binary else F.slice)(F.coalesce("t", empty), k * F.lit(largest) + 1, F.lit(largest))
    cut = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), part)).alias("piece", "tokens"))
    length = F.octet_length("tokens") if binary else F.size("tokens")
    return cut.select("doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * F.lit(largest)).cast("long").alias("start"), length.cast("long").alias("length"), "tokens")


def pack_sequences(docs: DataFrame, tokens: Column, capacities: tuple[int, ...] = CAPACITIES, name: str = "packing") -> DataFrame:
    """A row a bin: bin, capacity, length, doc_ids, pieces (doc_id, piece, start, offset, length), tokens.

    ``tokens``: binary (a byte is a token) or an array of int.  Positions of a piece run from 0 at its offset.
    """
    capacities = tuple(sorted(capacities))
    work = shared.Workspace(docs.sparkSession, name)
    cut = work.keep(pieces(docs, tokens, capacities[-1]).withColumn("n", F.monotonically_increasing_id()))
    id_type, token_type = cut.schema["doc_id"].dataType, cut.schema["tokens"].dataType
    real = cut.where(F.col("length") > 0)
    many, total = real.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-many // GROUP), -(-total // GROUP_TOKENS))
    piece = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("piece long, start long, offset long, length long").fields])
    schema = T.StructType([*T.StructType.fromDDL("bin long, capacity long, length long").fields, T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("pieces", T.ArrayType(piece)), T.StructField("tokens", token_type)])
    binary = isinstance(token_type, T.BinaryType)

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("n", "ascending")]).combine_chunks()
        length = table.column("length").to_numpy()
        where, sizes = pack(length.tolist(), capacities)
        order = np.argsort(np.array(where, np.int64), kind="stable")
        by = table.take(pa.array(order))
        own = length[order]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(np.array(where, np.int64), minlength=len(sizes)))))
        ends = np.concatenate(([0], np.cumsum(own)))
        bounds = pa.array(cuts, pa.int32())
        offset = ends[:-1] - np.repeat(ends[cuts[:-1]], np.diff(cuts))
        flat = lambda c: by.column(c).combine_chunks() if not isinstance(by.column(c), pa.ChunkedArray) else pa.concat_arrays(by.column(c).chunks)
        ids = flat("doc_id")
        parts = pa.StructArray.from_arrays([ids, flat("piece"), flat("start"), pa.array(offset, pa.int64()), pa.array(own, pa.int64())], names=["doc_id", "piece", "start", "offset", "length"])
        at = ends[cuts]
        if binary:
            whole = b"".join(flat("tokens").to_pylist())
            toks = pa.array([whole[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        else:
            toks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat("tokens").flatten())
        number = (key[0].as_py() << 32) + np.arange(len(sizes))
        return pa.table({"bin": pa.array(number, pa.int64()), "capacity": pa.array(sizes, pa.int64()), "length": pa.array(np.diff(at), pa.int64()), "doc_ids": pa.ListArray.from_arrays(bounds, ids), "pieces": pa.ListArray.from_arrays(bounds, parts), "tokens": toks})

    dealt = real.withColumn("group", F.pmod(F.xxhash64("n"), F.lit(groups)))
    bins = dealt.groupBy("group").applyInArrow(shared.grouped(run), schema)
    one = F.struct("doc_id", "piece", "start", F.lit(0).cast("long").alias("offset"), "length")
    none = cut.where(F.col("length") == 0).select(F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("capacity"), F.lit(0).cast("long").alias("length"), F.array("doc_id").alias("doc_ids"), F.array(one).alias("pieces"), "tokens")
    return bins.unionByName(none)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = BYTE_CAPACITIES, name: str = "packing") -> DataFrame:
    """Texts as sequences of their UTF-8 bytes, packed."""
    return pack_sequences(docs, docs["text"].cast("binary"), capacities, name)
