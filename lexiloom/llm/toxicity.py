"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of a word that several training texts have (word input) and
the scaled sum of its hashed character trigram embeddings (character input). Windows of ``LENGTH`` words overlap and cover the
whole text; two gated recurrent passes, one from each end, give a state per word, attention
weights pool them, and a logistic unit scores the window. A text's score is its highest
window's, shifted so that 0.5 separates the classes with the fewest errors on held-back training rows.

Trained on a bounded sample: about ``train_rows`` labelled ids of each class, chosen by a hash
of the id, of their different rows at most about twice as many, and of these, in the order of a
hash, as many as have ``train_bytes`` of text, whole texts with all their windows. After the first epoch, windows of positive texts that
the network finds clean are left out: the label says that a text is toxic somewhere.

Inputs are words only: digits and punctuation part words and are left out, and a word that
follows itself at once counts once, in training and in scoring alike, before windows are cut.

Defined cases. Null or blank text: one empty window. Rows without a label never train.
Repeated rows train once and are scored one by one; an id with both labels trains with both.
A score of exactly 0.5 is predicted 1. A very long text is scored alone, in all its windows. No
training rows of both classes: every score is 0. Empty table: no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch

TRAIN_ROWS = 1500
TRAIN_BYTES = 32 << 20
LENGTH, STRIDE = 48, 36
HIDDEN, DIM, ATTEND = 8, 8, 8
CHAR_BITS = 13


#: Words are runs of ASCII letters and of bytes of other scripts; an immediate repeat counts once.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False

#: A word has an embedding of its own if at least so many texts of the sample have it.
MIN_TEXTS = 5


class Vocabulary:
    """Distinct words of some rows: per word its hash and its trigrams; per token its word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words = kernels.Words(data, at, lower=True, gap=NO_LETTER)
        hashes = words.hashes()
        again = np.zeros(len(hashes), dtype=bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[words.first[:-1][words.first[:-1] < len(hashes)]] = False
        self.first = words.first - np.concatenate(([0], np.cumsum(again)))[words.first]
        _, head, token = np.unique(hashes, return_index=True, return_inverse=True)
        self.token = token[~again]
        self.word = hashes[head]
        start, end = words.start[head], words.end[head]
        length = end - start
        self.edge = np.concatenate(([0], np.cumsum(length)))
        pos = np.arange(self.edge[-1]) + np.repeat(start - self.edge[:-1], length)
        text = words.data.astype(np.uint64)
        left, right = text[np.maximum(pos - 1, 0)], text[np.minimum(pos + 1, max(len(text) - 1, 0))]
        if len(pos):
            left[self.edge[:-1]] = 32
            right[self.edge[1:] - 1] = 32
        code = left << np.uint64(16) | text[pos] << np.uint64(8) | right
        self.trigram = (kernels.mix(code) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.word)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first token in the row) of the windows that cover each row; one for an empty row."""
    n = np.maximum(-(-np.maximum(counts - LENGTH, 0) // STRIDE), 0) + 1
    row = np.repeat(np.arange(len(counts)), n)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    p: dict[str, np.ndarray]
    known: np.ndarray  # hashes of words with an embedding; row 0 is for all others
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int, known: np.ndarray) -> Net:
        g = np.random.default_rng(seed)
        f = lambda *s, scale=None: (g.standard_normal(s) * (scale or 1 / np.sqrt(s[0]))).astype(np.float32)
        p = {"ew": f(len(known) + 1, DIM, scale=0.1), "ec": f(1 << CHAR_BITS, DIM, scale=0.3)}
        for d in "fb":
            p |= {f"w{d}": f(2 * DIM, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"a": f(2 * HIDDEN, ATTEND), "ab": np.zeros(ATTEND, np.float32), "v": f(ATTEND, 1), "o": f(2 * HIDDEN, 1), "ob": np.zeros(1, np.float32)}
        return Net(p, known)

    def numbers(self, v: Vocabulary) -> np.ndarray:
        """Embedding rows of the distinct words."""
        at = np.searchsorted(self.known, v.word)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == v.word, at + 1, 0) if len(self.known) else np.zeros(len(v), np.int64)

    def embed(self, v: Vocabulary) -> np.ndarray:
        """Inputs of the distinct words: word embedding and trigram embedding (sum over root of length) side by side."""
        if not len(v):
            return np.zeros((0, 2 * DIM), np.float32)
        chars = np.add.reduceat(self.p["ec"][v.trigram], v.edge[:-1], axis=0) / np.sqrt(np.diff(v.edge))[:, None]
        return np.concatenate((self.p["ew"][self.numbers(v)], chars.astype(np.float32)), axis=1)

    def _pass(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction, time first; with ``keep`` also what the gradient needs."""
        steps, n = idx.shape
        u = self.p[f"u{d}"]
        uz, un = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        memo = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            xt = x[idx[t]]
            g = sigmoid(xt[:, : 2 * HIDDEN] + h @ uz)
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            hn = h @ un
            c = np.tanh(xt[:, 2 * HIDDEN :] + r * hn)
            new = c + z * (h - c)
            m = mask[t][:, None]
            new = h + m * (new - h)
            if keep:
                memo.append((t, h, r, z, hn, c, m))
            h = new
            out[t] = h
        return out, memo

    def forward(self, e: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows ``idx`` (time first, numbers of rows of ``e``)."""
        p = self.p
        xs, hs, memos = {}, [], {}
        for d in "fb":
            xs[d] = e @ p[f"w{d}"] + p[f"b{d}"] if len(e) else np.zeros((1, 3 * HIDDEN), np.float32)
            h, memos[d] = self._pass(xs[d], idx, mask, d, keep)
            hs.append(h)
        h = np.concatenate(hs, axis=2)
        k = np.tanh(h @ p["a"] + p["ab"])
        s = (k @ p["v"])[:, :, 0] + (mask - 1) * 1e4
        s = np.exp(s - s.max(axis=0))
        alpha = s * mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = (alpha[:, :, None] * h).sum(axis=0)
        logit = (pooled @ p["o"])[:, 0] + p["ob"][0]
        return (logit, (h, k, alpha, pooled, memos)) if keep else logit

    def gradients(self, v: Vocabulary, e: np.ndarray, idx: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (h, k, alpha, pooled, memos) = self.forward(e, idx, mask, True)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d[:, None], "ob": d.sum(keepdims=True)}
        dpool = d[:, None] @ p["o"].T
        da = (h * dpool).sum(axis=2)
        ds = alpha * (da - (alpha * da).sum(axis=0))
        dk = ds[:, :, None] * p["v"][:, 0] * (1 - k * k)
        g["v"] = np.einsum("tna,tn->a", k, ds)[:, None]
        g["a"] = np.einsum("tnh,tna->ha", h, dk)
        g["ab"] = dk.sum(axis=(0, 1))
        dh = alpha[:, :, None] * dpool + dk @ p["a"].T
        de = np.zeros_like(e)
        for i, way in enumerate("fb"):
            u = p[f"u{way}"]
            gu, dx = np.zeros_like(u), np.zeros((len(e), 3 * HIDDEN), np.float32)
            back = np.zeros((idx.shape[1], HIDDEN), np.float32)
            for t, before, r, z, hn, c, m in reversed(memos[way]):
                back = back + dh[t][:, i * HIDDEN : (i + 1) * HIDDEN]
                new = back * m
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (before - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                drz = np.concatenate((dr, dz), axis=1)
                gu[:, : 2 * HIDDEN] += before.T @ drz
                gu[:, 2 * HIDDEN :] += before.T @ (dc * r)
                np.add.at(dx, idx[t], np.concatenate((drz, dc), axis=1))
                back = back * (1 - m) + new * z + drz @ u[:, : 2 * HIDDEN].T + (dc * r) @ u[:, 2 * HIDDEN :].T
            g[f"u{way}"], g[f"b{way}"], g[f"w{way}"] = gu, dx.sum(axis=0), e.T @ dx
            de += dx @ p[f"w{way}"].T
        g["ew"] = np.zeros_like(p["ew"])
        np.add.at(g["ew"], self.numbers(v), de[:, :DIM])
        length = np.diff(v.edge)
        g["ec"] = np.zeros_like(p["ec"])
        np.add.at(g["ec"], v.trigram, np.repeat(de[:, DIM:] / np.sqrt(length)[:, None], length, axis=0))
        return g


class _Part(Vocabulary):
    """Some words of a vocabulary, renumbered."""

    def __init__(self, of: Vocabulary, which: np.ndarray):
        self.word = of.word[which]
        length = np.diff(of.edge)[which]
        self.edge = np.concatenate(([0], np.cumsum(length)))
        self.trigram = of.trigram[np.arange(self.edge[-1]) + np.repeat(of.edge[:-1][which] - self.edge[:-1], length)]


def layout(v: Vocabulary, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token word numbers and mask of windows, time first."""
    at = v.first[row] + start
    n = np.minimum(v.first[row + 1] - at, LENGTH)
    pos = np.arange(LENGTH)[:, None]
    mask = (pos < n).astype(np.float32)
    token = v.token[np.minimum(at + pos, max(len(v.token) - 1, 0))] if len(v.token) else np.zeros((LENGTH, len(row)), np.int64)
    return np.where(mask > 0, token, 0), mask


def row_logits(net: Net, v: Vocabulary, most: int = 4096) -> np.ndarray:
    """The highest window logit of each row."""
    row, start = windows(np.diff(v.first))
    e = net.embed(v)
    logit = np.empty(len(row), np.float32)
    for i in range(0, len(row), most):
        logit[i : i + most] = net.forward(e, *layout(v, row[i : i + most], start[i : i + most]))
    return np.maximum.reduceat(logit, np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))) if len(row) else logit


def train(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Net | None:
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    packed = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(packed), dtype=np.uint8)
    v = Vocabulary(data, np.concatenate(([0], np.cumsum([len(b) for b in packed]))))
    held = rng.random(len(y)) < 0.2
    row, start = windows(np.diff(v.first))
    use = every = np.flatnonzero(~held[row])
    texts_of = np.unique(np.stack((kernels.row_of(v.first), v.token)), axis=1)[1]
    net = Net.fresh(seed, v.word[np.bincount(texts_of, minlength=len(v)) >= MIN_TEXTS])
    memory = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch >= 1:  # of each text its highest window, of clean texts some others too
            e = net.embed(v)
            found = np.concatenate([net.forward(e, *layout(v, row[every[i : i + 4096]], start[every[i : i + 4096]])) for i in range(0, len(every), 4096)])
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, row[every], found)
            clean = y[row[every]] == 0
            use = every[(found >= best[row[every]]) | clean & ((found > -2) | (rng.random(len(every)) < 0.1))]
        positive = use[y[row[use]] == 1]
        times = max(1, (len(use) - len(positive)) // max(len(positive), 1))
        use = np.concatenate([use] + [positive] * min(times - 1, 6))
        order = rng.permutation(use)
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            idx, mask = layout(v, row[pick], start[pick])
            some, small = np.unique(idx, return_inverse=True)
            part = _Part(v, some)
            g = net.gradients(part, net.embed(part), small.reshape(idx.shape), mask, y[row[pick]].astype(np.float32))
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():  # Adam
                x = x * min(1.0, 5.0 / max(norm, 1e-9)) + decay * net.p[k]
                m, s = memory[k]
                m += 0.1 * (x - m)
                s += 0.001 * (x * x - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    logits = row_logits(net, v)
    net.shift = threshold(logits[held], y[held]) if len(set(y[held].tolist())) == 2 else threshold(logits, y)
    return net


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    wrong = np.cumsum(t == 1) + (t == 0).sum() - np.cumsum(t == 0)
    best = np.flatnonzero(wrong[:-1] <= wrong[:-1].min())
    k = best[np.argmax(s[best + 1] - s[best])]
    return float((s[k] + s[k + 1]) / 2)


def scorer(model):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for rows, data, at in kernels.batches(source, "text"):
            score = np.zeros(rows.num_rows) if net is None else sigmoid(row_logits(net, Vocabulary(data, at)).astype(np.float64) - net.shift)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Net | None:
    """The network of labelled rows whose crc32(doc_id) mod 5 isn't 0, about ``train_rows`` per class."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (rest != 0)).distinct()
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    pick = F.lit(False)
    for value, n in sizes.items():
        pick |= (F.col("toxic") == value) & (F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, train_rows / n) * (1 << 30))))
    chosen = F.broadcast(known.where(pick))  # about two times train_rows
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    sample = scratch.sampled(found, "toxic", "toxicity", 2 * train_rows, train_bytes)  # ids may have several texts
    return train([r.text for r in sample], [r.toxic for r in sample])


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train_rows))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    out = scratch.arrow(slim, scorer(model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
