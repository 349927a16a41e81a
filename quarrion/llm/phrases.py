"""Collocations of 2 to 4 words by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass n over the texts counts n-grams exactly and, into hash buckets, the (n+1)-grams both of whose n-grams are still
possible. A bucket under the least count rules out all its (n+1)-grams. Pass n + 1 therefore counts only those whose
bucket is full and whose two n-grams are frequent. Both tests are bitmaps, which are broadcast: their slots grow
with the text up to 2 ** MOST_BITS, so 16 MB each. They let too much through (by collisions), never too little,
and what passes is counted by the words themselves, so results are exact at any size.

Tasks tokenise their texts as byte arrays, a language at a time, count into bounded dictionaries and one byte a bucket
(full is full: sums stop at the least count, which doesn't change what is full); Spark adds up what they emit. Scores,
pruning and ranks are DataFrame operations on the frequent n-grams.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.llm import common as C

LEAST, LONGEST, INSIDE, TOP = 30, 4, 80, 2000
#: Bytes of text for a slot of the bitmaps, and bounds of the binary logarithm of their number.
SLOT_BYTES, FEWEST_BITS, MOST_BITS = 64, 16, 27
#: Bytes of text that are tokenised at a time; phrases that a task counts before it emits them; slots of a block of counts.
CHUNK, HELD, BLOCK = 1 << 19, 200_000, 1 << 16
#: Pieces that a language's candidates are ranked in before they meet.
SALTS = 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
SHAPE = "lang string, gram string, n long, block int, data binary"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)).replace(b"\t", b" ")
_KIND = np.array([2 if c in SEPARATORS else 1 if c in b" \t" else 0 for c in range(256)], "u1")
_TO_BLANK = bytes(32 if c in SEPARATORS else c for c in range(256))
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_UNROLL = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX, _NEXT, _MARK = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's factor and of its inverse, kept for the process up to a chunk's length."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        made = tuple(np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, x)])) for x in (_ROLL, _UNROLL))
        if n > 2 * CHUNK:
            return made
        _POWERS[:] = [made]
    return _POWERS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


_BYTES = _mixed(np.arange(1, 257, dtype="u8") * _ROLL)


class Words:
    """The words of a lower-cased text in one language: places, pieces and hashes."""

    def __init__(self, text: bytes, lang: str):
        self.text = text
        a = np.frombuffer(text, "u1")
        kind = _KIND[a]
        edge = np.diff(np.concatenate([np.zeros(1, "i1"), (kind == 0).view("i1"), np.zeros(1, "i1")]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype="i4")[self.starts] if len(a) else np.zeros(0, "i4")
        up, down = _powers(len(a))
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTES[a] * up[: len(a)])])
        self.hash = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + np.uint64(zlib.crc32(lang.encode()) * int(_NEXT) % (1 << 64)))
        self.close = self.starts[1:] - self.ends[:-1] == 1  # one blank between

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n words from each word on, of pieces or across them."""
        g = self.hash
        for k in range(1, n):
            g = _mixed(g[:-1] * _NEXT + self.hash[k:])
        return g

    def within(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one piece."""
        return self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        found = [self.text[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), strict=True)]
        loose = np.flatnonzero(~np.logical_and.reduce([self.close[at + k] for k in range(n - 1)])) if n > 1 else ()
        for i in loose:
            found[i] = b" ".join(found[i].split())
        return found


def _slots(g: np.ndarray, bits: int, factor: np.uint64) -> np.ndarray:
    return (g * factor) >> np.uint64(64 - bits)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype("u1")) & np.uint8(1) != 0


def parts(text: bytes, chunk: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """(part, words of it that earlier parts have counted) of a text. Long texts are cut between pieces; pieces that are
    longer, between words, and the next part then begins with the last words once more, for phrases across the cut."""
    at = new = lead = 0
    while len(text) - new > chunk:
        cut = max(text.rfind(bytes([c]), new, new + chunk) for c in SEPARATORS)
        if cut < 0:
            cut = text.rfind(b" ", new, new + chunk)
        if cut < 0:
            found = re.compile(b"[" + re.escape(SEPARATORS) + b" ]").search(text, new + chunk)
            if not found:
                break
            cut = found.start()
        yield text[at:cut], lead
        if text[cut] == 32:
            last = [m.start() for m in re.finditer(b"[^ ]+", text[at:cut])][1 - longest :]
            at, lead = at + last[0] if last else cut, len(last)
        else:
            at, lead = cut + 1, 0
        new = cut + 1
    yield text[at:], lead


def chunks(batches, chunk: int, longest: int) -> Iterator[tuple[str, bytes, int]]:
    """(lang, lower-cased text, words counted before), of batches of lang and text; short texts of a language together."""
    for b in batches:
        open_: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = text.translate(_LOWER)
            if len(text) > chunk:
                yield from ((lang, *x) for x in parts(text, chunk, longest))
                continue
            if size[lang] + len(text) > chunk:
                yield lang, b"\n".join(open_.pop(lang)), 0
                size[lang] = 0
            open_.setdefault(lang, []).append(text)
            size[lang] += len(text) + 1
        for lang, texts in open_.items():
            yield lang, b"\n".join(texts), 0


def _emit(lang: list, gram: list, n: list, block: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], schema=C.arrow(SHAPE))


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(counts), BLOCK):
        if counts[k : k + BLOCK].any():
            yield _emit([None], [None], [None], [k // BLOCK], [counts[k : k + BLOCK].tobytes()])


def _counts(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, c in held.items():
        for k in range(0, len(c), 50_000):
            some = list(c.items())[k : k + 50_000] if len(c) > 50_000 else list(c.items())
            yield _emit([lang] * len(some), [x for x, _ in some], [y for _, y in some], [None] * len(some), [None] * len(some))


def counting(n: int, bits: int, least: int, longest: int, chunk: int, marks, full) -> Callable:
    """The pass over texts that counts n-grams, and buckets of (n+1)-grams. marks, full: broadcast bitmaps of the frequent
    (n-1)-grams and of the full buckets of n-grams; not used where n is 1."""

    def run(batches):
        held: dict[str, Counter] = {}
        buckets = np.zeros(1 << bits if n < longest else 0, "u1")
        for lang, text, lead in chunks(batches, chunk, longest):
            w = Words(text, lang)
            m = len(w.starts)
            if m <= max(lead, n - 1):
                continue
            c = held.setdefault(lang, Counter())
            if n == 1:
                ok = np.ones(m, bool)
                c.update(text.translate(_TO_BLANK).split()[lead:])
            else:
                known = _has(marks.value, _slots(w.grams(n - 1), bits, _MARK))
                ok = w.within(n) & known[:-1] & known[1:]
                at = np.flatnonzero(ok)
                ok[at] = _has(full.value, _slots(w.grams(n)[at], bits, _MIX))
                at = np.flatnonzero(ok)
                c.update(w.phrases(at[at + n > lead], n))
            if n < longest and m > n:
                at = np.flatnonzero(ok[:-1] & ok[1:] & w.within(n + 1))
                slots, k = np.unique(_slots(w.grams(n + 1)[at[at + n + 1 > lead]], bits, _MIX), return_counts=True)
                buckets[slots] = np.minimum(buckets[slots] + k, least)
            if sum(map(len, held.values())) > HELD:
                yield from _counts(held)
                held = {}
        yield from _counts(held)
        yield from _blocks(buckets)

    return run


def marking(n: int, bits: int, least: int) -> Callable:
    """Blocks of counts in which the slots of the frequent n-grams are full; of batches of lang and gram."""

    def run(batches):
        buckets = np.zeros(1 << bits, "u1")
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, g in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, []).append(g)
            for lang, some in by.items():
                w = Words(b"\n".join(some), lang)
                buckets[_slots(w.grams(n)[w.within(n)], bits, _MARK)] = least
        yield from _blocks(buckets)

    return run


def bitmap(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bitmap, 2 ** bits of them, of the slots whose counts sum to `least` or more. A task adds up its blocks as they come."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(data, "u1")
                sums[k] = np.minimum(sums[k] + got.astype("u2"), least) if k in sums else got.astype("u2")
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes()], pa.binary())], schema=C.arrow("block int, bits binary"))

    found = rows.where("block is not null").select("block", "data")
    tasks = max(C.partitions(rows.sparkSession), (1 << bits) // BLOCK // 64)
    out = np.zeros((1 << bits) // 8, "u1")
    for r in found.repartition(tasks, "block").mapInArrow(run, "block int, bits binary").collect():  # 2 ** bits bits in all
        out[r.block * BLOCK // 8 :][: len(r.bits)] = np.frombuffer(bytes(r.bits), "u1")
    return out


def bits_for(text_bytes: int) -> int:
    return min(max((max(text_bytes, 1) // SLOT_BYTES).bit_length(), FEWEST_BITS), MOST_BITS)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((lang, words, gram, a) of the phrases of up to `longest` words with a >= least occurrences; (lang, n) words of each language)."""
    if not 1 <= least <= 255:
        raise ValueError("least is from 1 to 255: buckets count up to it in a byte")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), C.text_of().alias("text"))
    if bits is None:
        bits = bits_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    found, totals, marks, full = None, None, None, None
    for n in range(1, longest + 1):
        raw = C.cut(rows.mapInArrow(counting(n, bits, least, longest, chunk, marks, full), SHAPE), f"grams{n}")
        for sent in (marks, full) if n > 1 else ():
            sent.unpersist()
        counted = raw.where("block is null").groupBy("lang", "gram").agg(F.sum("n").alias("a"))
        if n == 1:
            totals = C.cut(raw.where("block is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        some = C.cut(counted.where(F.col("a") >= least).select("lang", F.lit(n).alias("words"), "gram", "a"), f"frequent{n}")
        found = some if found is None else found.unionByName(some)
        if n < longest:
            full = sc.broadcast(bitmap(raw, bits, least))
            marks = sc.broadcast(bitmap(some.select("lang", "gram").mapInArrow(marking(n, bits, least), SHAPE), bits, least))
        C.discard(raw)
    return found, totals


def _looked_up(parts_: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """parts_ with the count of the phrase in column `part`, as `name`. A part that begins or ends very many phrases is dealt out."""
    key = lambda c: F.concat("lang", F.lit("\n"), F.col(c))  # noqa: E731  phrases hold no line ends
    left = parts_.withColumn("_key", key(part))
    hot = left.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > C.hot_limit(parts_.count()))
    return C.salted_join(left, known.select(key("gram").alias("_key"), F.col("a").alias(name)), "_key", hot).drop("_key")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of the phrases of two words or more, by their weakest cut; found: frequent()."""
    w = F.split("gram", " ", -1)
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    many = found.where("words > 1").select("lang", "gram", "words", "a", cuts)
    many = many.select("*", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    many = C.cut(many, "cuts")
    both = _looked_up(_looked_up(many, found, "first", "l"), found, "rest", "r")
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 as decimal(38, 0)) div (cast(l as decimal(20, 0)) + r)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return both.groupBy("lang", "gram", "words", "a").agg(least).select("lang", F.col("gram").alias("phrase"), "words", "a", "m.l", "m.r", "m.score")


def outermost(candidates: DataFrame, found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """candidates without those inside a longer phrase that has `inside` percent of their occurrences or more."""
    w, n = F.split("gram", " ", -1), F.col("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    inner = found.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    largest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer_a"))
    kept = candidates.join(largest, ["lang", "phrase"], "left")
    # 100 * f >= inside * a, without leaving 64 bits
    gone = F.expr(f"cast(outer_a as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(inside)}")
    return kept.where(F.coalesce(~gone, F.lit(True))).drop("outer_a")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first `top` phrases of each language of documents(text, lang).

    Null texts are empty, null languages are `und`; a language without a phrase that often has no rows. Repeated rows count as often as
    they stand there; ids aren't read, nor are other columns. Texts and pieces of any length are counted whole, in chunks.
    Ties: the larger a, then the phrase in byte order. An empty table gives an empty result.
    """
    found, totals = frequent(docs, least, bits=bits, chunk=chunk)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = outermost(scored(found), found).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = best.withColumn("_rn", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rn") <= top)  # SALTS * top rows a language
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
