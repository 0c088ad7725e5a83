"""Vectorised word splitting and hashing over many texts at once (numpy only, no Spark).

Words are maximal runs of bytes other than space and \\t..\\r.  A word's hash is a polynomial over
its bytes modulo 2**64, taken from prefix sums and finished by a mixer, so equal words have equal
hashes in every task and no dictionary of words is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are worked on in pieces of about so many bytes; a longer text makes a piece of its own.
CHUNK_BYTES = 1 << 19
KEPT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(U) * U(4) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k = 1
    while k < n:
        step = min(k, n - k)
        out[k : k + step] = out[:step] * U(pow(base, k, 1 << 64))
        k += step
    return out


class _Powers:
    """Powers of a base and of its inverse; only the first KEPT are held from call to call."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > KEPT:
            return powers(self.base, n), powers(self.inverse, n)
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        return self.up, self.down


_POW = _Powers(BASE)
_POW2 = _Powers(0xD6E8FEB86659FD93)


def chunks(texts: list, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of consecutive pieces; None counts as empty."""
    start, part, held = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        if part and held + len(b) > size:
            yield start, part
            start, part, held = i, [], 0
        part.append(b)
        held += len(b) + 1
    if part:
        yield start, part


class Words:
    """The words of several texts: byte spans, owners and hashes.

    ``buf``: all texts, each followed by a line feed; ``start``/``end``: byte spans of the words;
    ``first``: index of each text's first word, with the total at the end; ``hash``: by word.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray | None = None, separators: np.ndarray = _SPACE):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        if table is not None:
            buf = table[buf]
        space = separators[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.buf, self.start, self.end = buf, edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        up, down = _POW.get(len(buf) + 1)
        sums = np.empty(len(buf) + 1, U)
        sums[0] = 0
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Spans:
    """Hashes of runs of words from prefix sums over the words' hashes; 128 bits by two bases."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        self.sums = []
        for p, salt in ((_POW, 0x51ED270B), (_POW2, 0x2545F491)):
            up, down = p.get(n)
            s = np.empty(n, U)
            s[0] = 0
            np.cumsum(mix(hashes + U(salt)) * up[: n - 1], out=s[1:])
            self.sums.append((s, down))

    def get(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s, down = self.sums[which]
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])
