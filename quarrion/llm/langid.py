"""Language identification by n-gram filters that answer with a bitmask of languages.

Training counts character n-grams by language and keeps those with at least SHARE of the
language's, so at most 1 / SHARE a language. All languages share one Bloom filter, sliced by
bit: each of its slots holds a mask with one bit a language, an n-gram sets its language's
bit in PROBES slots, and a lookup ANDs those slots, giving all languages that hold the
n-gram at once. A document's n-grams are counted by language (popcounts of the masks'
bits); from each count goes what the language's own false-positive rate leads to expect, and
the largest decides.

The training sample is bounded: about SAMPLE labelled documents of each language, the first
SAMPLE_CHARS characters of each. Every language with a training row is learned, however small
its share; a table with over LANGS languages is refused. Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C
from quarrion.llm.toxicity import held_out

SAMPLE, SAMPLE_CHARS = 2000, 20_000
LANGS = 500
GRAM = 4
SHARE = 2e-5
SLOTS, PROBES = 1 << 20, 3
#: Characters that are looked up at a time.
CHUNK = 1 << 18
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype="u8")
_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters, one table a process."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _IS_LETTER[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str):
    """Hashes of the n-grams of a lower-cased text, other characters than letters as blanks; those with two
    blanks or more in a row are left out. In chunks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    blank = ~_letters()[codes]
    codes = np.where(blank, 32, codes).astype("u8")
    for k in range(0, len(codes), CHUNK):
        c, b = codes[k : k + CHUNK + GRAM - 1], blank[k : k + CHUNK + GRAM - 1]
        n = len(c) - GRAM + 1
        if n <= 0:
            return
        h, bad = np.zeros(n, "u8"), np.zeros(n, bool)
        for j in range(GRAM):
            h = (h ^ (c[j : j + n] * _MIX[j])) * _MIX[3]
            h ^= h >> np.uint64(29)
            if j:
                bad |= b[j - 1 : j - 1 + n] & b[j : j + n]
        yield h[~bad]


def _slots(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step * np.uint64(0x9E3779B1)) >> np.uint64(7)) & np.uint64(SLOTS - 1) for k in range(PROBES)]


@dataclass
class Filter:
    """langs, by code point; masks: SLOTS rows of one 64-bit word for each 64 languages."""

    langs: list[str]
    masks: np.ndarray = field(default=None)
    wrong: np.ndarray = field(default=None)

    @classmethod
    def build(cls, known: dict[str, np.ndarray]) -> Filter:
        """known: the kept n-gram hashes of each language."""
        f = cls(sorted(known))
        f.masks = np.zeros((max(1, -(-len(f.langs) // 64)), SLOTS), "u8")
        fill = np.zeros(len(f.langs))
        for i, lang in enumerate(f.langs):
            bit = np.uint64(1 << (i % 64))
            for s in _slots(known[lang]):
                f.masks[i // 64][s] |= bit
            fill[i] = ((f.masks[i // 64] & bit) != 0).mean()
        f.wrong = fill**PROBES
        return f

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams, and for each language how many of them it holds."""
        n, found = 0, np.zeros(len(self.langs), np.int64)
        for h in grams(text):
            n += len(h)
            slots = _slots(h)
            for w, mask in enumerate(self.masks):
                got = mask[slots[0]]
                for s in slots[1:]:
                    got &= mask[s]
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    found[i] += np.count_nonzero(got & np.uint64(1 << (i % 64)))
        return n, found

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); und without a letter or a learned language. Ties go to the first by code point."""
        if not text or not has_letter(text) or not self.langs:
            return "und", 0.0
        n, found = self.counts(text)
        right = np.maximum((found - n * self.wrong) / (1 - self.wrong), 0.0)
        best = int(np.argmax(right))
        second = float(np.delete(right, best).max()) if len(right) > 1 else 0.0
        return self.langs[best], float(right[best] / (right[best] + second)) if right[best] > 0 else 0.0


def fit(docs: DataFrame) -> Filter:
    """Learn from documents(doc_id, text, lang) that aren't held out; null languages and texts don't count."""
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = known.groupBy("lang").count().withColumnRenamed("count", "n")
    n = {r.lang: r.n for r in per.limit(LANGS + 1).collect()}
    if len(n) > LANGS:
        raise ValueError(f"more than {LANGS} languages are labelled")
    if not n:
        return Filter.build({})
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(13)), 11) / F.lit(float(1 << 53))
    rate = F.element_at(F.create_map(*(F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, SAMPLE / k)))), F.col("lang"))
    some = known.where(F.col("lang").isin(list(n)) & (u < rate)).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    shape = "lang string, gram long, n long"
    schema = C.arrow(shape)

    def count(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(grams(text))
            for lang, parts in by.items():
                g, k = np.unique(np.concatenate(parts) if parts else np.zeros(0, "u8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view("i8")), pa.array(k.astype("i8"))], schema=schema)

    counted = C.cut(some.mapInArrow(count, shape).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sums = {r.lang: r.s for r in counted.groupBy("lang").agg(F.sum("n").alias("s")).collect()}
    least = F.element_at(F.create_map(*(F.lit(x) for lang, s in sums.items() for x in (lang, max(2.0, s * SHARE)))), F.col("lang")) if sums else F.lit(2.0)
    rows = counted.where(F.col("n") >= least).select("lang", "gram").toPandas()  # 1 / SHARE rows a language at most
    found = {lang: np.sort(g["gram"].to_numpy().view("u8")) for lang, g in rows.groupby("lang")}
    return Filter.build({lang: found.get(lang, np.zeros(0, "u8")) for lang in n})


def identified(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents(doc_id, text, lang).

    Null texts and those without a letter: und, score 0. Letters but no n-gram of any language: the first
    language, score 0. Without training rows all are und. Null ids are predicted, not learned from. Repeated
    rows are learned from as often as they stand there, and predicted alike; an empty table gives an empty
    result; columns with the result's names, and others, aren't read.
    """
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words for each 64 languages
    shape = "doc_id long, held_out boolean, lang_pred string, score double"
    schema = C.arrow(shape)

    def run(batches):
        m = sent.value
        for b in batches:
            got = [m.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, shape)
