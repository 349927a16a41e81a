"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Texts are cut into windows of WORDS words. The ordinary dictionary is trained (by the library's
COVER trainer) on windows of ordinary documents. Toxic documents are ordinary text for the most
part, so the windows that the toxic dictionaries are trained on are found by compression, too:
starting from all windows of toxic documents, dictionaries are trained on disjoint parts of the
documents, and the windows that stay are those which the other parts' dictionaries shorten by more than
they do all but a small share (1 - QUANTILE) of ordinary windows; this is repeated ROUNDS times.

A window's distance is its compressed length under the ordinary dictionary less that under the toxic one,
which has the toxic content before the ordinary. There are PARTS toxic dictionaries, of disjoint
documents, and the least of their distances counts, so that a match by chance in one isn't enough. Each window is
followed by a fixed pad that all dictionaries hold, without which the format would store anything so
short as it is. The numbers and shares of a document's windows whose distances reach the LEVELS go through a
logistic curve, which is calibrated by cross-fitting, on documents that the dictionaries which measured them
were not trained on.

The training sample is bounded: about SAMPLE documents of each label, and SAMPLE_CHARS
characters of each. Scoring reads whole texts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C

SAMPLE = {0: 3000, 1: 1500}
SAMPLE_CHARS = 20_000
WORDS = 4
#: Windows of a training document that dictionaries are trained on: of ordinary ones spread over the text, of toxic ones all.
ORDINARY_WINDOWS = 200
#: Bytes of a training window; longer ones are cut.
WINDOW_BYTES = 200
#: Bytes of the ordinary dictionary, of the trainer's segments and of the strings it counts.
ORDINARY = (110_000, 64, 8)
#: Bytes of a toxic dictionary: so many a toxic training document, within bounds. Segments and strings.
TOXIC_PER_DOCUMENT, TOXIC_LEAST, TOXIC_MOST = 12, 4096, 16384
SEGMENTS = (24, 8)
PARTS, ROUNDS, QUANTILE = 2, 5, 0.98
#: Fewest windows that a part goes on with.
LEAST = 10
#: Ordinary windows that the quantile is taken from.
MEASURED = 20_000
LEVELS = (1, 2, 4)
#: Any fixed bytes that texts in lower case don't hold.
PAD = bytes(65 + k * k * 7 % 26 for k in range(48))
#: Windows that are compressed at a time.
CHUNK = 1 << 14
#: Windows whose distances a task keeps.
KNOWN = 1 << 19
#: A document is predicted toxic from this score on.
LIMIT = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def windows(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    return [b" %b " % b" ".join(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]


def compressor(content: bytes):
    """A compressor with the dictionary."""
    p = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def lengths(compressor, some: list[bytes]) -> np.ndarray:
    if not some:
        return np.zeros(0, "i4")
    got = compressor.multi_compress_to_buffer([x + PAD for x in some], threads=1)  # a call for all
    return np.fromiter(map(len, got), "i4", len(some))


def trained(samples: list[bytes], shape: tuple[int, int, int]) -> bytes:
    """A dictionary trained on the samples; where they are too few for the trainer, the samples themselves."""
    size, k, d = shape
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def distances(ordinary, toxic: list, some: list[bytes]) -> np.ndarray:
    """Bytes that each window gains under the toxic dictionary that gains least; 0 where one gains none."""
    base = lengths(ordinary, some)
    least = np.maximum(base - lengths(toxic[0], some), 0)
    for c in toxic[1:]:
        open_ = np.nonzero(least)[0]
        least[open_] = np.minimum(least[open_], np.maximum(base[open_] - lengths(c, [some[i] for i in open_.tolist()]), 0))
    return least


def toxic_dictionaries(ordinary: bytes, toxic: list[list[bytes]], plain: list[bytes]) -> list[bytes]:
    """PARTS dictionaries of disjoint documents, from the windows of toxic documents; plain: ordinary windows."""
    all_, of = [x for w in toxic for x in w], np.repeat(np.arange(len(toxic)), [len(w) for w in toxic])
    part = np.array([zlib.crc32(f"{i}".encode()) % PARTS for i in range(len(toxic))])[of]
    shape = (min(max(TOXIC_PER_DOCUMENT * len(toxic), TOXIC_LEAST), TOXIC_MOST), *SEGMENTS)
    compress = compressor(ordinary)
    base, plain_base = lengths(compress, all_), lengths(compress, plain)
    stay = np.ones(len(all_), bool)
    for _ in range(ROUNDS):
        held = [trained([all_[i] for i in np.nonzero(stay & (part == p))[0]], shape) for p in range(PARTS)]
        found = [compressor(x + ordinary) for x in held]
        gain, plain_gain = (np.array([b - lengths(c, some) for c in found]) for b, some in ((base, all_), (plain_base, plain)))
        now = np.zeros(len(all_), bool)
        for p in range(PARTS):
            others, own = [q for q in range(PARTS) if q != p], part == p
            limit = max(np.quantile(plain_gain[others].min(axis=0), QUANTILE, method="higher"), 0) if len(plain) else 0
            now[own] = gain[others][:, own].min(axis=0) > limit
        if min(np.bincount(part[now], minlength=PARTS)) < LEAST:  # too few documents to tell: as before
            break
        stay = now
    return [trained([all_[i] for i in np.nonzero(stay & (part == p))[0]], shape) for p in range(PARTS)]


@dataclass
class Model:
    ordinary: bytes
    toxic: list[bytes]
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def open(self) -> Model:
        """Prepare the compressors, once a process."""
        self.plain, self.others = compressor(self.ordinary), [compressor(t + self.ordinary) for t in self.toxic]
        self.known: dict[bytes, int] = {}
        return self

    def gains(self, some: list[bytes]) -> np.ndarray:
        """distances(), of which those of the last KNOWN windows are kept: lines and passages come again in other documents."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [x for x in dict.fromkeys(some) if x not in self.known]
        self.known.update(zip(new, distances(self.plain, self.others, new).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, some), "i4", len(some))

    def features(self, text: str) -> tuple[float, ...]:
        some, counts = windows(text), np.zeros(len(LEVELS))
        for k in range(0, len(some), CHUNK):
            d = self.gains(some[k : k + CHUNK])
            counts += [(d >= x).sum() for x in LEVELS]
        share = np.minimum(100 * counts / max(len(some), 8), 25.0)
        return (1.0, *np.log1p(counts).tolist(), *share.tolist())

    def score(self, text: str | None) -> float:
        if not self.weights or not (text or "").split():
            return self.prior
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _dictionaries(texts: list[str], labels: list[int]) -> Model:
    cut = [[x[:WINDOW_BYTES] for x in windows(t)] for t in texts]
    plain = [w[:: max(1, -(-len(w) // ORDINARY_WINDOWS))] for w, y in zip(cut, labels, strict=True) if not y]
    plain = [x for w in plain for x in w]
    step = max(2, len(plain) // MEASURED)  # these aren't trained on
    ordinary = trained([x for i, x in enumerate(plain) if i % step], ORDINARY)
    return Model(ordinary, toxic_dictionaries(ordinary, [w for w, y in zip(cut, labels, strict=True) if y], plain[::step]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[int, int, str]]) -> Model:
    """Model of (doc_id, toxic, text); a constant score where a label is missing."""
    rows = sorted((r for r in rows if r[2].split()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    labels, texts = [int(r[1] == 1) for r in rows], [r[2] for r in rows]
    if len(set(labels)) < 2:
        return Model(b" ", [], prior=float(labels[0]) if labels else 0.0)
    x: list[tuple[float, ...]] = [()] * len(rows)
    for fold in (0, 1, 2):  # each third is measured by dictionaries of the other two
        rest = [i for i in range(len(rows)) if i % 3 != fold]
        m = _dictionaries([texts[i] for i in rest], [labels[i] for i in rest]).open()
        for i in range(fold, len(rows), 3):
            x[i] = m.features(texts[i])
    y = np.array(labels, dtype=float)
    model = _dictionaries(texts, labels)
    model.weights = tuple(map(float, _logistic(np.array(x), y)))
    # The sample's balance differs from the corpus', which the caller sets right.
    model.prior = float(y.mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, id_: str = "doc_id") -> Model:
    """Train on labels(doc_id, toxic) that aren't held out, joined with documents(doc_id, text).

    The sample is drawn by hash of the id, at rates that give about SAMPLE rows a label.
    Null labels and ids don't count; of differing labels of one id the larger holds, of its differing texts the
    largest. Other columns aren't read; without rows of both labels, the score is constant.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {y: min(1.0, SAMPLE[y] / n[y]) for y in n}
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / F.lit(float(1 << 53))
    some = known.where(u < F.when(F.col("toxic") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)))
    texts = docs.where(~held_out()).select("doc_id", F.substring(C.text_of(), 1, SAMPLE_CHARS).alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).collect()  # bounded: see above
    model = train([tuple(r) for r in rows])
    if model.weights and rate.get(0) and rate.get(1):  # back to the labels' own balance
        shift = math.log(rate[0] / rate[1])
        model.weights = (model.weights[0] + shift, *model.weights[1:])
        model.prior = n.get(1, 0) / sum(n.values())
    return model


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of documents(doc_id, text).

    Null and blank texts get the share of toxic labels as score. Without labels of both kinds
    the score is constant. Null ids and repeated rows are scored like others; other columns
    aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = model or fit(docs, labels)
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size and some numbers
    shape = "doc_id long, held_out boolean, score double"
    schema = C.arrow(shape)

    def run(batches):
        m = sent.value.open()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.score(t) for t in b.column(2).to_pylist()], pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, shape).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns, whatever their names; text alone is read of them.

    Null and blank texts get the share of toxic labels as score. Repeated rows share a fate, null ids are scored like
    others, and an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    limit = LIMIT

    def run(batches):
        m = sent.value.open()
        for b in batches:
            keep = [m.score(t) < limit for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
