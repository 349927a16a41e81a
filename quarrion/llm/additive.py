"""Text quality by a generalised additive model with pairwise interactions.

A text's features (lengths, character classes, repetition) are binned at quantiles of the training sample. The model is a
lookup table for each feature and one for each chosen pair of features; a score is the logistic curve of the sum of a text's
entries. Tables are learned by cyclic boosting: turn after turn, each feature in order gets a tree of two levels on its
bins, fitted to the current residuals, a small share of which is added to its table; pairs come after that, first ranked by what
one cut of each feature gains on the residuals, then boosted in the same way. Scoring is a few vectorised lookups and additions
for a batch.

The training sample is bounded: about SAMPLE labelled documents of each label, whole texts. Of these only features
come to the driver.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C

SAMPLE = {0: 4000, 1: 8000}
#: A document is predicted good from this score on.
LIMIT = 0.3
#: Most bins of a feature; bins of a feature in a pair.
BINS, COARSE = 64, 8
#: Turns of boosting for features and pairs, the share of a tree that is added, the least hessian of a leaf, and its ridge.
ROUNDS, PAIR_ROUNDS, RATE, LEAST, RIDGE = 150, 60, 0.1, 2.0, 1.0
PAIRS = 6
#: Bytes of text whose classes are counted at a time.
CHUNK = 1 << 20
NAMES = ("chars", "words", "word_length", "longest_word", "short_words", "upper", "digits", "symbols", "calls", "stops", "line_ends", "other_bytes", "distinct_words", "repeats", "repeated_lines")
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>@^~=+_\\/{}[]", "!?", ".,;:", "\n", " \t\r\x0b\x0c")
_KIND = np.full(256, len(_CLASSES), "i8")
for _k, _some in enumerate(_CLASSES):
    _KIND[[ord(c) for c in _some]] = _k


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Bytes of each class, a row a text, computed over many texts at a time and in parts of long ones."""
    k = len(_CLASSES) + 1
    out = np.zeros((len(texts), k), "i8")
    for part in C.slices(texts, map(len, texts), CHUNK):
        some = texts[part]
        if len(some) == 1:
            for at in range(0, len(some[0]), CHUNK):
                out[part.start] += np.bincount(_KIND[np.frombuffer(some[0][at : at + CHUNK], "u1")], minlength=k)
        else:
            of = np.repeat(np.arange(len(some)) * k, [len(t) for t in some])
            out[part] = np.bincount(of + _KIND[np.frombuffer(b"".join(some), "u1")], minlength=len(some) * k).reshape(-1, k)
    return out


def word_features(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 7
    sizes = np.fromiter(map(len, words), "i8", n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(map(operator.eq, words, words[1:]))
    return (math.log1p(n), float(sizes.mean()), math.log1p(int(sizes.max())), float((sizes <= 3).mean()), len(set(words)) / n, repeats / n, 1 - len(set(lines)) / max(len(lines), 1))


def features(texts: list[str | None]) -> np.ndarray:
    """A row of NAMES a text; null counts as empty, for which all are 0. Shares are of the text's bytes, words or lines."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    w = np.array([word_features(t) for t in raw], "f8").reshape(-1, 7)
    c = class_counts(raw).astype("f8")
    total = np.maximum(c.sum(axis=1), 1)
    upper = c[:, 0] / np.maximum(c[:, 0] + c[:, 1], 1)
    shares = c / total[:, None]
    return np.column_stack([np.log1p(c.sum(axis=1)), w[:, 0], w[:, 1], w[:, 2], w[:, 3], upper, *shares[:, 2:7].T, shares[:, 8], w[:, 4], w[:, 5], w[:, 6]])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def best_cut(g: np.ndarray, h: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """(gain, cut) of the best two parts of bins a to b: bins before the cut, and from it on; (0, a) where none gains."""
    if b - a < 2:
        return 0.0, a
    left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
    all_g, all_h = g[a:b].sum(), h[a:b].sum()
    gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    gain[(left_h < LEAST) | (all_h - left_h < LEAST)] = 0
    k = int(gain.argmax())
    return (float(gain[k]), a + k + 1) if gain[k] > 0 else (0.0, a)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of two levels on the bins, from sums of residuals and hessians by bin."""
    n = len(g)
    _, top = best_cut(g, h, 0, n)
    cuts = {0, n, top, best_cut(g, h, 0, top)[1], best_cut(g, h, top, n)[1]}
    out, edges = np.zeros(n), sorted(cuts)
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values by cell) of the best one cut of each of two features, from sums by cell."""
    sums = [np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (g, h)]
    corners = []
    for s in sums:
        ul = s[:-1, :-1]
        up, left = s[:-1, -1:], s[-1:, :-1]
        corners.append((ul, up - ul, left - ul, s[-1, -1] - up - left + ul))
    gain = sum(_gain(a, b) for a, b in zip(*corners, strict=True)) - _gain(sums[0][-1, -1], sums[1][-1, -1])
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(*corners, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


@dataclass
class Model:
    """edges: of each feature's bins; tables: by bin; pairs: (feature, feature, table by their coarse bins)."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)])

    def coarse(self, b: np.ndarray) -> np.ndarray:
        return np.column_stack([b[:, i] * COARSE // (len(e) + 1) for i, e in enumerate(self.edges)])

    def total(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        if self.pairs:
            c = self.coarse(b)
            for i, j, t in self.pairs:
                z += t[c[:, i], c[:, j]]
        return z

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return 1 / (1 + np.exp(-np.clip(self.total(features(texts)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost tables on rows of features and labels 0 and 1; a constant where only one label is there."""
    if len(y) == 0 or y.min() == y.max():
        return Model(constant=float(y[0]) if len(y) else 0.0)
    m = Model([np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for i in range(x.shape[1])])
    b = m.bins(x)
    m.intercept = math.log(y.mean() / (1 - y.mean()))
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.intercept)
    p = 1 / (1 + np.exp(-z))
    for _ in range(ROUNDS):
        for i, t in enumerate(m.tables):
            g, h = np.bincount(b[:, i], y - p, len(t)), np.bincount(b[:, i], p * (1 - p), len(t))
            step = RATE * tree(g, h)
            t += step
            z += step[b[:, i]]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    c = m.coarse(b)

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        cell = c[:, i] * COARSE + c[:, j]
        return tuple(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p)))

    gains = sorted(((-quadrants(*sums(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:PAIRS]
    m.pairs = [(i, j, np.zeros((COARSE, COARSE))) for gain, i, j in gains if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            step = RATE * quadrants(*sums(i, j))[1]
            t += step
            z += step[c[:, i], c[:, j]]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return m


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labels(doc_id, quality) that aren't held out, joined with documents(doc_id, text).

    The sample is drawn by hash of the id, at rates that give about SAMPLE rows a label. Null labels and ids don't
    count; of differing labels of one id the larger holds, of differing texts those with the largest features. Without
    rows of both labels, the score is constant.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    rate = {y: min(1.0, SAMPLE[y] / n[y]) for y in n}
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) / F.lit(float(1 << 53))
    some = known.where(u < F.when(F.col("quality") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded: see SAMPLE
    shape = "doc_id long, quality int, x array<double>"
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features(b.column(2).to_pylist())), pa.list_(pa.float64()))], schema=schema)

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text").mapInArrow(measure, shape).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x")).orderBy("doc_id").collect()
    m = train(np.array([r.x for r in got], "f8").reshape(-1, len(NAMES)), np.array([r.quality for r in got], "f8"))
    if m.constant is None:  # back to the labels' own balance
        m.intercept += math.log(rate[0] / rate[1])
    return m


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of documents(doc_id, text).

    Null texts are scored like empty ones, by the model as any other; texts of any length are read whole. Without labels of both
    kinds the score is constant. Null ids and repeated rows are scored like others, ties at the limit are predicted 1; other
    columns, also of the result's names, aren't read; an empty table gives an empty result.
    """
    model = model or fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of bounded size
    shape = "doc_id long, held_out boolean, score double"
    schema = C.arrow(shape)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.scores(b.column(2).to_pylist()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, shape).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
