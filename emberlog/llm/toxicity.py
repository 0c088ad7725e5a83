"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs are characters and words: a word's vector is its embedding, if enough documents of the sample have
the word, plus the mean of the hashed embeddings of its byte trigrams.  Both directions of a gated recurrent unit run over every overlapping
window of WINDOW words (step STEP, the last window ends with the text); attention pools the states, a
logistic unit scores the window, and a document has its highest window's score.

Training: a bounded sample of labelled rows (``TRAIN_ROWS`` of each class at most, by hash of the id), of any length: a
text beyond ``TRAIN_CHARS`` characters gives ``TRAIN_PIECES`` pieces, evenly spaced over all of it.  A document's label is that of its windows' maximum, so after a first
round over all windows, gradients go through each document's best window.

Scoring is one narrow pass.  Weights are a constant size, and so is the memory of a task: texts are cut into
pieces of about a megabyte, in which equal words share one input vector.

Defined results: null, empty and wordless texts score as one window of padding; copies score alike; with
no labelled row of some class all scores are the share of toxic labels (0.0 without labels); rows without a
doc_id are scored and never learnt from; an empty table gives no rows; passed columns named like the results give
way to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import U, Words, chunks

WINDOW, STEP = 32, 16
CHARS, DIM, HIDDEN, ATT = 1 << 12, 12, 8, 8
#: A word has a vector of its own from so many documents of the sample on; others have their trigrams only.
LEAST = 4
TRAIN_ROWS, TRAIN_CHARS, TRAIN_PIECES = 1000, 20_000, 20
STEPS, BATCH, RATE = 900, 32, 0.01
#: Steps of the vectors, by plain gradient: words that few texts have stay small.
RATE_INPUT = {"word": 20.0, "char": 2.0}
#: Steps after which each text's best window is chosen anew.
AGAIN = 60
#: Windows that run through the network at a time.
LANES = 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: all ASCII but letters and digits.
_APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
F4 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F4(0.5) * np.tanh(F4(0.5) * x) + F4(0.5)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a piece: hashes, trigram slots and their owners; and each token's word (from 1; 0 pads)."""
    if not len(w.hash):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    distinct, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    s, e = w.start[first], w.end[first]
    n = e - s + 1  # trigrams over the word with one mark before and after it
    owner = np.repeat(np.arange(len(distinct)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = s[owner] + inner - 1
    buf = w.buf
    left = np.where(inner == 0, 1, buf[np.maximum(at, 0)]).astype(np.int64)
    mid = np.where(inner + s[owner] < e[owner], buf[np.minimum(at + 1, len(buf) - 1)], 2).astype(np.int64)
    right = np.where(inner + s[owner] + 1 < e[owner], buf[np.minimum(at + 2, len(buf) - 1)], 2).astype(np.int64)
    tri = ((left * 65599 + mid) * 65599 + right) * 2654435761 >> 8
    return distinct, tri % CHARS, owner, back + 1


class Net:
    """Weights and both passes of the network."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 3):
        r = np.random.RandomState(seed)
        self.vocabulary = vocabulary  # sorted hashes
        init = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(F4)
        self.p = {"word": np.zeros((len(vocabulary) + 1, DIM), F4), "char": init(CHARS, DIM, scale=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": init(DIM, 3 * HIDDEN, scale=0.4), f"u{d}": init(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, F4)}
        self.p |= {"a": init(2 * HIDDEN, ATT, scale=0.3), "ab": np.zeros(ATT, F4), "v": init(ATT, scale=0.5), "o": init(2 * HIDDEN, scale=0.3), "ob": np.full(1, -2, F4)}

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the words' own vectors; the last, which stays zero, is for all others."""
        n = len(self.vocabulary)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), n - 1)
        return np.where(self.vocabulary[at] == hashes, at, n)

    def inputs(self, words: np.ndarray, tri: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Vectors of distinct words; row 0 pads."""
        x = np.zeros((len(words) + 1, DIM), F4)
        if len(words):
            n = np.bincount(owner, minlength=len(words))
            starts = np.cumsum(n) - n
            x[1:] = self.p["word"][words] + np.add.reduceat(self.p["char"][tri], starts, axis=0) / n[:, None].astype(F4)
        return x

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Scores (logits) of windows: ids (windows, WINDOW) into x; padding takes no attention."""
        n, length = ids.shape
        states = np.zeros((length, n, 2 * HIDDEN), F4)
        tape: dict = {"f": [], "b": []}
        for d, lo in (("f", 0), ("b", HIDDEN)):
            u, proj = self.p[f"u{d}"], x @ self.p[f"w{d}"] + self.p[f"b{d}"]
            uzr, uh = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            h = np.zeros((n, HIDDEN), F4)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                g = proj[ids[:, t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ uzr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ uh)
                new = h + z * (c - h)
                if keep:
                    tape[d].append((t, h, z, r, c))
                h = new
                states[t, :, lo : lo + HIDDEN] = h
        hidden = np.tanh(states @ self.p["a"] + self.p["ab"])
        e = hidden @ self.p["v"]
        e[ids.T == 0] = -30
        e[0, (ids == 0).all(axis=1)] = 0
        e = np.exp(e - e.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", att, states)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, states, tape, hidden, att, pooled) if keep else logit

    def gradients(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the mean cross-entropy, by name; "x": of the input vectors."""
        logit, states, tape, hidden, att, pooled = self.forward(x, ids, True)
        p, n = self.p, len(ids)
        d = ((_sigmoid(logit) - y) * weight / n).astype(F4)
        g = {"o": pooled.T @ d, "ob": np.array([d.sum()], F4)}
        dpool = d[:, None] * p["o"]
        datt = np.einsum("nh,tnh->tn", dpool, states)
        dstates = att[:, :, None] * dpool[None]
        de = att * (datt - (att * datt).sum(axis=0))
        de[ids.T == 0] = 0
        g["v"] = np.einsum("tn,tna->a", de, hidden)
        da = de[:, :, None] * p["v"] * (1 - hidden**2)
        g["a"], g["ab"] = np.einsum("tnh,tna->ha", states, da), da.sum(axis=(0, 1))
        dstates += da @ p["a"].T
        dx = np.zeros_like(x)
        for k, lo in (("f", 0), ("b", HIDDEN)):
            u = p[f"u{k}"]
            du, dproj = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), F4)
            dh = np.zeros((n, HIDDEN), F4)
            for t, h, z, r, c in reversed(tape[k]):
                dh = dh + dstates[t, :, lo : lo + HIDDEN]
                dc = dh * z * (1 - c**2)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                du[:, : 2 * HIDDEN] += h.T @ dzr
                du[:, 2 * HIDDEN :] += (r * h).T @ dc
                np.add.at(dproj, ids[:, t], np.concatenate((dzr, dc), axis=1))
                dh = dh * (1 - z) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
            g[f"u{k}"], g[f"w{k}"], g[f"b{k}"] = du, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"w{k}"].T
        g["x"] = dx
        return g


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first word inside it, length) of all windows; the last ends with the text; an empty text has one."""
    n = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STEP) + 1)
    owner = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.maximum(0, np.minimum(k * STEP, counts[owner] - WINDOW))
    return owner, first, np.minimum(counts[owner], WINDOW)


def _ids(w: Words, back: np.ndarray, owner: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = w.first[owner][:, None] + first[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, np.append(back, 0)[np.minimum(at, len(back))], 0)


def train(texts: list[str], labels: list[int], seed: int = 3) -> Net:
    """Fits a network to whole texts."""
    rng = np.random.RandomState(seed)
    w = Words([t.encode("utf-8", "surrogatepass") for t in texts], _LOWER, _APART)
    hashes, tri, tri_owner, back = features(w)
    pairs = np.unique(np.repeat(np.arange(len(texts)), w.counts()) * (len(hashes) + 1) + back)
    in_texts = np.bincount(pairs % (len(hashes) + 1), minlength=len(hashes) + 1)[1:]
    net = Net(hashes[in_texts >= LEAST], seed)
    words = net.slots(hashes)
    owner, first, length = windows_of(w.counts())
    ids = _ids(w, back, owner, first, length)
    y = np.array(labels, F4)
    trigrams = np.bincount(tri_owner, minlength=len(words))
    start = np.cumsum(trigrams) - trigrams
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    while step < STEPS:
        if step < STEPS // 5:
            # no window can be chosen yet: some of each document, at random
            pick = _some(owner, len(texts), 6, rng)
        else:
            logit = np.concatenate([net.forward(net.inputs(words, tri, tri_owner), ids[k : k + LANES]) for k in range(0, len(ids), LANES)])
            order = np.lexsort((logit, owner))
            pick = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
        rounds = -(-AGAIN * BATCH // len(pick))
        pick = np.concatenate([rng.permutation(pick) for _ in range(rounds)])[: max(AGAIN * BATCH, len(pick))]
        for k in range(0, len(pick), BATCH):
            sub = ids[pick[k : k + BATCH]]
            used, local = np.unique(sub, return_inverse=True)
            local = local.reshape(sub.shape)
            has_pad = used[0] == 0
            real = used[1:] - 1 if has_pad else used - 1
            if not has_pad:
                local = local + 1
            own = np.repeat(np.arange(len(real)), trigrams[real])
            inner = np.arange(len(own)) - np.repeat(np.cumsum(trigrams[real]) - trigrams[real], trigrams[real])
            own_tri = tri[start[real][own] + inner]
            target = y[owner[pick[k : k + BATCH]]]
            share = max(0.02, float(y.mean()))
            weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(F4)
            g = net.gradients(net.inputs(words[real], own_tri, own), local, target, weight)
            dx = g.pop("x")[1:]
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], words[real], dx)
            g["word"][-1] = 0
            np.add.at(g["char"], own_tri, (dx / np.maximum(1, trigrams[real])[:, None])[own])
            step += 1
            for name, grad in g.items():
                if name in ("word", "char"):
                    net.p[name] -= F4(RATE_INPUT[name] * max(0.1, 1 - step / STEPS)) * grad
                    continue
                m, v = moments[name]
                m += F4(0.1) * (grad - m)
                v += F4(0.001) * (grad**2 - v)
                net.p[name] -= F4(RATE * max(0.1, 1 - step / STEPS)) * (m / F4(1 - 0.9**step)) / (np.sqrt(v / F4(1 - 0.999**step)) + F4(1e-8))
    return net


def _some(owner: np.ndarray, n: int, each: int, rng) -> np.ndarray:
    """Up to ``each`` windows of every document, at random."""
    order = np.lexsort((rng.random_sample(len(owner)), owner))
    counts = np.bincount(owner, minlength=n)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[rank < each]


def score_texts(net: Net, texts: list) -> np.ndarray:
    """Scores (0 to 1) of whole texts."""
    out = np.zeros(len(texts))
    for at, part in chunks(texts):
        w = Words(part, _LOWER, _APART)
        hashes, tri, tri_owner, back = features(w)
        x = net.inputs(net.slots(hashes), tri, tri_owner)
        owner, first, length = windows_of(w.counts())
        best = np.full(len(part), -np.inf)
        for k in range(0, len(owner), LANES):
            o = owner[k : k + LANES]
            np.maximum.at(best, o, net.forward(x, _ids(w, back, o, first[k : k + LANES], length[k : k + LANES])))
        out[at : at + len(part)] = 1 / (1 + np.exp(-best))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed) -> list[tuple[str, int]]:
    """The bounded training sample: TRAIN_ROWS of each class at most, of rows for which ``allowed`` (a Column on doc_id) holds."""
    usable = labels.select(labels["doc_id"], labels["toxic"]).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    found: list[tuple[str, int]] = []
    n, size = F.length("text"), TRAIN_CHARS // TRAIN_PIECES
    spread = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_PIECES - 1)), lambda k: F.substring("text", (k * (n - size) / F.lit(TRAIN_PIECES - 1)).cast("int") + 1, F.lit(size)))
    bounded = F.when(n <= TRAIN_CHARS, F.col("text")).otherwise(F.array_join(spread, "\n"))
    texts = docs.select(docs["doc_id"], docs["text"]).where(F.col("text").isNotNull()).select("doc_id", bounded.alias("text"))
    for label in (0, 1):
        some = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select("doc_id")
        rows = texts.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_ROWS).collect()
        found += [(r["text"], label) for r in rows]
    return found


def fit(docs: DataFrame, labels: DataFrame, allowed):
    """A network, or a constant score where a class is missing."""
    sample = labelled_sample(docs, labels, allowed)
    y = [label for _, label in sample]
    if len(set(y)) < 2:
        return float(np.mean(y)) if y else 0.0
    return train([t for t, _ in sample], y)


def score(docs: DataFrame, model, columns: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The named columns, score and predicted (under the given names); no shuffle."""
    from pyspark.sql import types as T

    columns = shared.passed(columns, list(names))
    rows = docs.select(docs["text"].alias("_text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)], T.StructField("score", T.DoubleType())])
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared_model.value
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(k, 512)
                texts = b.column(0).to_pylist()
                s = np.full(len(texts), net) if isinstance(net, float) else score_texts(net, texts)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], names=[*b.schema.names[1:], "score"])

    out = shared.mapped(rows, run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("score").alias(names[0]), (F.col("score") >= 0.5).cast("int").alias(names[1]))
