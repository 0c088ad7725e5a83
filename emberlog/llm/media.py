"""Media columns: content-addressed payloads in tar shards.

Every payload is stored once, under the digest of its stored form, as an 8-bit greyscale PNG in a tar
shard in the shared folder; rows carry digest, shard, offset and length.  Metadata columns come from
range reads of the images' headers only; features come from whole payloads read back.

How it runs: payloads are encoded and stored where their rows are, so no payload is shuffled.  Each task
writes shards of a bounded size, each named by its own content, and stores what it meets several times once;
a task that runs again after a lost executor writes the same files.  Only the index (small rows) is
shuffled: where several tasks stored the same payload, one place is chosen for all rows, and the others are
orphans that a sweep may drop.  The index is written to the shared folder before it is read, so shards
are never written twice by a later read.

Defined results: a null payload counts as empty; an empty one is stored as 64 zero bytes; copies share
one stored object; an empty table gives an empty index and no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WIDTH = 64
#: Bytes from an image's start that hold its header: signature and IHDR chunk.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "text_sha256 binary, media_sha256 binary, shard string, offset long, length long"
#: Bytes from which a task begins a new shard, and digests that it remembers at a time.
SHARD_BYTES, REMEMBERED = 256 << 20, 1 << 20
META = INDEX + ", width long, height long, bit_depth int, payload_bytes long"


def pad(raw: bytes) -> bytes:
    """Appends zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image, 64 samples a line, losslessly."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _png_chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """width, height, bit depth from the first HEADER_BYTES."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return width, height, depth


def from_png(data: bytes) -> bytes:
    """The payload of a stored image; checks every chunk's CRC."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _Shard:
    """A tar file being written; takes its name when it is closed."""

    def __init__(self, filesystem: pafs.FileSystem, base: str):
        filesystem.create_dir(base, recursive=True)
        self.filesystem, self.base, self.part = filesystem, base, f"{base}/part-{uuid.uuid4().hex}"
        self.stream, self.own, self.at = filesystem.open_output_stream(self.part), hashlib.sha256(), 0
        self.rows: list[tuple[bytes, bytes, int, int]] = []

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.own.update(data)
        self.at += len(data)

    def add(self, digest: bytes, payload: bytes) -> None:
        png = to_png(payload)
        sha = hashlib.sha256(png)
        info = tarfile.TarInfo(f"{sha.hexdigest()}.png")
        info.size = len(png)
        self.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.rows.append((digest, sha.digest(), self.at, len(png)))
        self.write(png)
        self.write(b"\0" * (-len(png) % tarfile.BLOCKSIZE))

    def close(self) -> pa.RecordBatch:
        self.stream.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.stream.close()
        name = f"{self.own.hexdigest()}.tar"
        self.filesystem.move(self.part, f"{self.base}/{name}")
        d, sha, offset, length = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(sha, pa.binary()), pa.array([name] * len(d)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["text_sha256", "media_sha256", "shard", "offset", "length"])


def write_shards(payloads: DataFrame, target: str) -> DataFrame:
    """payloads(text_sha256 binary, payload binary) to an index of shards under the URI ``target``.

    The result is lazy: write it to a table before reading it twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _store(target)
        seen: set[bytes] = set()
        shard = None
        for b in batches:
            for d, raw in zip(b.column(0), b.column(1), strict=True):
                d = d.as_py()
                if d in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                shard = shard or _Shard(filesystem, base)
                shard.add(d, pad(raw.as_py() or b""))
                if shard.at >= SHARD_BYTES:
                    yield shard.close()
                    shard = None
        if shard is not None:
            yield shard.close()

    return payloads.select("text_sha256", "payload").mapInArrow(write, INDEX)


def _ranges(b: pa.RecordBatch, target: str, size) -> Iterator[tuple[int, bytes]]:
    """(row, bytes) of each range, opening each shard once in a run of rows."""
    filesystem, base = _store(target)
    shards, offsets, lengths = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length"))
    name, f = None, None
    for i in sorted(range(b.num_rows), key=lambda i: (shards[i], offsets[i])):
        if shards[i] != name:
            if f is not None:
                f.close()
            name, f = shards[i], filesystem.open_input_file(f"{base}/{shards[i]}")
        yield i, f.read_at(size(lengths[i]), offsets[i])
    if f is not None:
        f.close()


def header_columns(index: DataFrame, target: str) -> DataFrame:
    """Metadata columns from range reads of HEADER_BYTES an object."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(0, 0, 0)] * b.num_rows
            for i, data in _ranges(b, target, lambda n: min(n, HEADER_BYTES)):
                got[i] = png_header(data)
            w, h, d = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
            extra = [pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(d, pa.int32()), pa.array([x * y for x, y in zip(w, h, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "width", "height", "bit_depth", "payload_bytes"])

    return index.mapInArrow(read, META)


def feature_of(samples: np.ndarray, width: int, height: int) -> str:
    """Shape, mean, spread and range of the samples, and how often they cross their mean."""
    x = samples.astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    above = x * n > total
    crossings = int((above[1:] != above[:-1]).sum())
    return f"{width}x{height};sum={total};sq={squares};min={int(x.min())};max={int(x.max())};cross={crossings}"


def payload_columns(index: DataFrame, target: str) -> DataFrame:
    """Reads whole payloads back and computes their digests and features."""
    fields = "payload_sha256 binary, tail_crc32 long, media_read_sha256 binary, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list = [None] * b.num_rows
            for i, data in _ranges(b, target, lambda n: n):
                payload = from_png(data)
                samples = np.frombuffer(payload, np.uint8)
                got[i] = (hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).digest(), feature_of(samples, WIDTH, len(payload) // WIDTH))
            cols = [list(x) for x in zip(*got, strict=True)] if got else [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*b.schema.names, "payload_sha256", "tail_crc32", "media_read_sha256", "feature"])

    return index.mapInArrow(read, META + ", " + fields)


def media_columns(docs: DataFrame, target: str | None = None, name: str = "media") -> DataFrame:
    """Every row of docs(doc_id, text) with its payload's columns.

    ``target``: URI of the shards' folder; without one they live in the session's workspace and go with it.
    """
    spark: SparkSession = docs.sparkSession
    work = shared.Workspace(spark, name)
    target = target or f"{work.root}/shards"
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    key = F.unhex(F.sha2(F.col("text"), 256))
    index = work.keep(write_shards(rows.select(key.alias("text_sha256"), F.col("text").cast("binary").alias("payload")), target))
    stored = work.keep(payload_columns(header_columns(index, target), target))
    work.drop(index)
    rest = [c for c in stored.columns if c not in ("text_sha256", "shard", "offset")]
    place = stored.groupBy("text_sha256").agg(F.min(F.struct("shard", "offset", *rest)).alias("m"))
    small = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), key.alias("text_sha256"))
    out = small.join(place, "text_sha256").select("doc_id", "n_bytes", "m.*")
    low = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_bytes", "payload_bytes", low("payload_sha256").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), low("media_read_sha256").alias("media_sha256"), "feature", low("media_sha256").alias("digest"), "shard", "offset")
