"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased and everything else is a boundary; n-grams of one to three characters
are hashed into :data:`DIM` features. Term frequency is a share of the text's n-grams, inverse
document frequency is counted over all training rows. Weights are fitted by
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded sample:
about ``train_rows`` different labelled rows of each language, chosen by a hash of id and text,
and of these, in the hash's order, as many as have ``train_bytes`` of text, so a rare language
is learned beside a common one. A fifth of the sample calibrates the temperature. The tables
that are broadcast have a fixed size per language.

Defined cases. Null text or a text without a letter: ``und``, score 0. Rows without a label
never train. Repeated rows count one by one in document frequencies, train once and are scored
one by one. Ties between languages go to the first in the alphabet. A very long text is scored
alone, whole. No training rows: every row is ``und``. Empty table: no rows. Carried columns
that have the name of a new one are replaced; other extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch

BITS = 15
DIM = 1 << BITS
#: Of each language.
TRAIN_ROWS = 750
#: Of all languages.
TRAIN_BYTES = 32 << 20
UNKNOWN = "und"
SCALE = 8.0
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


def _letters() -> np.ndarray:
    """Code point -> folded letter, 32 for anything else; the first 65536."""
    out = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_TABLE: list[np.ndarray] = []


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows, and where each row starts."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    low = _TABLE[0][np.minimum(points, (1 << 16) - 1)]
    high = points >= 1 << 16
    if high.any():
        letter = np.array([chr(c).isalpha() for c in np.unique(points[high])])
        low = low.copy()
        low[high] = np.where(letter[np.searchsorted(np.unique(points[high]), points[high])], points[high], 32)
    return low, heads[at]


def features(c: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n of 1, 2, 3: (hashed n-grams of all rows, where each row starts). Blank ones are left out."""
    out = []
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    solid = c != 32
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(starts), np.int64)))
            continue
        h = np.full(m, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF), dtype=np.uint32)
        some = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ c[k : k + m]) * _MULTIPLY[k]
            h ^= h >> np.uint32(15)
            some |= solid[k : k + m]
        some &= row[:m] == row[n - 1 :]
        keep = np.flatnonzero(some)
        out.append(((h[keep] >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(keep, starts)))
    return out


def count_documents(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many rows each feature occurs; the last number counts rows."""
    total = np.zeros(DIM + 1, dtype=np.int64)
    for _, data, at in kernels.batches(source, "text"):
        c, starts = folded(data, at)
        parts = features(c, starts)
        for i in range(len(at) - 1):
            seen = np.zeros(DIM, dtype=bool)
            for idx, first in parts:
                seen[idx[first[i] : first[i + 1]]] = True
            total[:DIM] += seen
        total[DIM] += len(at) - 1
    if total[DIM]:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counters"])


def _frequencies(parts: list, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of row ``i`` with their shares of its n-grams."""
    idx = np.concatenate([h[first[i] : first[i + 1]] for h, first in parts])
    keys, n = np.unique(idx, return_counts=True)
    return keys, n / max(len(idx), 1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIM x languages, inverse document frequency included
    bias: np.ndarray
    temperature: float


class Ftrl:
    """FTRL-proximal with an elastic net, multinomial."""

    def __init__(self, dim: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its log."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).sum()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(texts: list[str], languages: list[str], df: np.ndarray, n_docs: int, epochs: int = 3, seed: int = 5) -> Model:
    names = sorted(set(languages))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    y = np.array([names.index(x) for x in languages])
    rows = []
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        c, starts = folded(data, np.array([0, len(data)]))
        keys, tf = _frequencies(features(c, starts), 0)
        rows.append((np.append(keys, DIM), np.append(SCALE * tf * idf[keys], 1.0)))
    order = np.random.default_rng(seed).permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    ftrl = Ftrl(DIM + 1, len(names))
    for _ in range(epochs):
        for i in train:
            if len(rows[i][0]) > 1:
                ftrl.learn(*rows[i], y[i])
    w = ftrl.weights(slice(None))
    logits = np.array([x @ w[keys] for keys, x in (rows[i] for i in held)]).reshape(-1, len(names))
    temperature = calibrate(logits, y[held])
    return Model(names, (w[:DIM] * (SCALE * idf)[:, None]).astype(np.float32), w[DIM].astype(np.float32), temperature)


def predict(model, columns: tuple[str, ...]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, data, at in kernels.batches(source, "text"):
            c, starts = folded(data, at)
            solid = np.concatenate(([0], np.cumsum(c != 32)))
            letters = solid[starts[1:]] > solid[starts[:-1]]
            k = len(m.languages)
            logits, total = np.zeros((len(letters), max(k, 1))), np.zeros(len(letters))
            if k:
                for idx, first in features(c, starts):
                    got = m.weights[idx]
                    full = np.flatnonzero(np.diff(first))
                    if len(full):
                        logits[full] += np.add.reduceat(got, first[:-1][full], axis=0)
                    total += np.diff(first)
                logits = (logits / np.maximum(total, 1)[:, None] + m.bias) / m.temperature
            p = softmax(logits)
            best = p.argmax(axis=1)
            sure = letters & (k > 0)
            names = pa.array([m.languages[b] if ok else UNKNOWN for b, ok in zip(best, sure)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(x) for x in columns] + [names, pa.array(np.where(sure, np.clip(p.max(axis=1), 0, 1), 0.0))], names=[*columns, "lang_pred", "score"])

    return run


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """The model of the labelled rows among those whose crc32(doc_id) mod 4 isn't 2."""
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(0))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    train = docs.select("doc_id", text, F.col("lang").cast("string").alias("lang")).where((rest != 2) & F.col("lang").isNotNull())
    totals = np.zeros(DIM + 1, dtype=np.int64)
    parts = scratch.arrow(train.select("text"), count_documents, "block int, counters binary")
    for _, counters in scratch.arrow(parts.repartition(F.col("block")), scratch.added, "block int, counters binary").toLocalIterator():
        totals += np.frombuffer(counters, dtype=np.int64)
    n = int(totals[DIM])
    if not n:
        return Model([], np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), 1.0)
    sample = scratch.sampled(train, "lang", "language", train_rows, train_bytes)
    return fit([r.text for r in sample], [r.lang for r in sample], totals[:DIM], n)


def identified(docs: DataFrame, train_rows: int = TRAIN_ROWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, train_rows))
    carry = tuple(c for c in carry if c not in ("lang_pred", "score"))
    names = tuple(f"c{i}" for i in range(len(carry)))
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col("text").cast("string").alias("text"))
    kinds = "".join(f"{c} {t}, " for c, t in slim.dtypes if c != "text")
    out = scratch.arrow(slim, predict(model, names), f"{kinds}lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "lang_pred", "score")
