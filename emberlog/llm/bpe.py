"""Byte-level BPE, exact and linear: longest matches with backtracking.

A sequence of tokens is what the merges would give exactly when every adjacent pair of it is
*compatible*: the bytes of the two, merged alone, give back these two tokens.  So a piece is encoded
by taking the longest vocabulary entry at each position and stepping back to the next shorter one
whenever it isn't compatible with the token before it.  Positions from which no continuation was
found are marked and never tried twice, which keeps the work linear.

Vocabulary entries live in an Aho-Corasick automaton; pyahocorasick takes strings, so bytes are
mapped to the first 256 code points (Latin-1).

Defined results: a null text counts as empty; an empty text has no tokens; lone surrogates can't
occur in Spark strings; texts of any length are handled (long pieces are matched in blocks); repeated rows and
rows without a doc_id are encoded like others; an empty table gives no rows; ``encode_texts`` passes all columns
through, and its result replaces a column of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

#: Entries of one generation of a worker's caches.
CACHE_ENTRIES = 250_000
#: Starts whose matches are held at a time within a very long piece.
BLOCK = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_alone(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging by lowest rank, leftmost first; only ever used on a pair of tokens or one token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _matches(automaton, text: str, longest: int):
    """A function from a start to the vocabulary entries there, shortest first; by blocks in a very long piece."""

    def block(lo: int) -> list[list[tuple[int, int]]]:
        size = min(BLOCK, len(text) - lo)
        found: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (token, n) in automaton.iter(text[lo : lo + BLOCK + longest] if len(text) > BLOCK else text):
            if end - n + 1 < size:
                found[end - n + 1].append((n, token))
        return found

    if len(text) <= BLOCK:
        return block(0).__getitem__
    held: dict[int, list] = {}

    def at(i: int) -> list[tuple[int, int]]:
        b = i // BLOCK
        if b not in held:
            if len(held) > 3:
                held.clear()
            held[b] = block(b * BLOCK)
        return held[b][i % BLOCK]

    return at


class _Recent:
    """A bounded memo in two generations: what wasn't asked for since the last turn goes first."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and self.old:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = value


class BytePairCodec:
    """Encodes whole texts and decodes ids; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        self.automaton, self.longest = ahocorasick.Automaton(), max(map(len, ranks))
        for b, r in ranks.items():
            self.token[r] = b
            self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.pieces = _Recent()

    def compatible(self, a: int, b: int) -> bool:
        ok = self.fits.get(a << 32 | b)
        if ok is None:
            if len(self.fits) > 2 * CACHE_ENTRIES:
                self.fits.clear()
            ok = self.fits[a << 32 | b] = merge_alone(self.token[a] + self.token[b], self.ranks) == [a, b]
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n, fits = piece.decode("latin-1"), len(piece), self.fits
        # Most pieces: the longest matches one after another are compatible as they stand.
        out, held, before = [], 0, -1
        for _, (token, size) in self.automaton.iter_long(text):
            if before >= 0 and not (fits.get(before << 32 | token) or self.compatible(before, token)):
                break
            out.append(token)
            held += size
            before = token
        if held == n:
            return out
        at = _matches(self.automaton, text, self.longest)
        pos, out, choice, dead = 0, [], [], bytearray(n + 1)
        options = at(0)
        k = len(options) - 1
        while pos < n:
            before = out[-1] << 32 if out else -1
            while k >= 0:
                size, token = options[k]
                if not dead[pos + size]:
                    if before < 0:
                        break
                    ok = fits.get(before | token)
                    if ok or ok is None and self.compatible(out[-1], token):
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                choice.append(k)
                pos += size
                if pos < n:
                    options = at(pos)
                    k = len(options) - 1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this piece")
                dead[pos] = 1
                pos -= len(self.token[out.pop()])
                options = at(pos)
                k = choice.pop() - 1
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
            if len(piece) <= 64:
                self.pieces.put(piece, ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        out, young = [], self.pieces.young
        for p in self.pattern.findall(text or ""):
            ids = young.get(p)
            if ids is None:
                ids = self._piece(p)
                young = self.pieces.young
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """This worker's codec for a rank file; the file is read once a worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids (array of int) of each text.  Narrow: no shuffle; other columns pass through."""
    fields = [f for f in df.schema.fields if f.name.lower() != ids.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            for k in range(0, max(1, b.num_rows), 256):
                part = b.slice(k, 256)
                got = pa.array([c.encode(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in fields] + [got], names=[f.name for f in fields] + [ids])

    return shared.mapped(df, run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        decimal = [str(i) for i in range(len(c.token))].__getitem__
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    return shared.mapped(docs.select(docs["doc_id"], docs["text"]), run, schema)
