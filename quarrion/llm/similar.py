"""Near-duplicates by word shingles: SimHash with BK-trees, then all else of Jaccard similarity of at least 0.8, exactly.

A document is the set of its 5-word shingles, as 64-bit hashes. Distinct sets, each with its
smallest doc_id, are the nodes. Each has a SimHash fingerprint. Sets that share one, and those that BK-trees
find within two bits (`simhash.links`), are compared as whole sets and make the first classes.

Most pairs of similarity 0.8 are more than two bits apart, so the rest is found between these classes: all sets are put in one global order, and of n shingles the
first n - ceil(0.8 n) + 1 are a set's prefix: two sets of similarity 0.8 share a shingle of
their prefixes. So sets meet by equality of prefix shingles. What a pair has in common lies at or after the first shingle that it shares,
in both sets, so a shingle so far back that too little follows needn't be tried: the pair meets in its first one, or isn't similar. Sketches rule out more: BITS parities of a set's shingles, of which two sets
differ in as many as they differ in shingles at most. The order has frequent shingles last, as counted over
all documents in a table of fixed size, which keeps common passages out of prefixes; it changes how many pairs
are tried, never which are found. What is left is decided on whole sets.

Only components are wanted. First, each set is tried against the one of those sharing a shingle
that has it foremost. Of a group of near copies that's one with few edits of its own, to which nearly all that
may be similar to any are similar: so a large group becomes one component by a number of trials
that grows with its size. Then the pairs that meet and are still in different components are tried: a shingle's first members
against all, and at last all; a round that joins components leaves fewer pairs to the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm import common as C
from quarrion.llm import simhash
from quarrion.llm.components import components
from quarrion.llm.simhash import one_of_each

SHINGLE = 5
#: Slots in which shingles are counted for the order, and rows that the slots' sums are made in. Results don't depend on them.
SLOTS, PARTS = 1 << 20, 64
#: Of the members of a shingle, those up to these places are tried against all, round by round; at last all are.
ROUNDS = (16,)
#: Bits of a sketch.
BITS = 1024
#: Texts whose shingles go into one Arrow batch.
BATCH = 256
#: Sets to verify up to which their ids (8 bytes each) are broadcast to find their texts.
BROADCAST = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype="u8")


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles, over words with A-Z lower-cased; a shorter text is one shingle, a blank one has none."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks alone
    if not words:
        return np.zeros(0, "u8")
    codes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype="u8")
    size = min(SHINGLE, len(words))
    h = np.full(len(words) - size + 1, size, "u8")
    for j in range(size):
        h = (h ^ codes[j : j + len(h)]) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), 42)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(C.text_of()).alias("h"), C.text_of().alias("text"))


def _sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(20)).astype("i8") % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, h (XXH64 of the text), fp (the set's hash), n (its size), sim (its SimHash fingerprint) and sketch, materialised."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sim", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = [(_name(s), len(s), simhash.of_hashes(s), _sketch(s)) for s in map(shingles, b.column(2).to_pylist())]
            fps, sims = (pa.array(np.array([r[k] for r in rows], dtype="u8").view("i8")) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, pa.array([r[1] for r in rows], pa.int32()), sims, pa.array([r[3] for r in rows], pa.list_(pa.int64()))], schema=schema)

    return C.cut(_text(docs).mapInArrow(run, "doc_id long, h long, fp long, n int, sim long, sketch array<long>"), "sets")


def _counted(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall into each of SLOTS slots: an estimate of their frequency, of fixed size."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    step = SLOTS // PARTS

    def run(batches):
        counts = np.zeros(SLOTS, "<u4")
        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), BATCH):
                h = np.concatenate([np.zeros(0, "u8"), *(shingles(t) for t in texts[k : k + BATCH])])
                counts += np.bincount(_slot(h), minlength=SLOTS).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([counts[k * step : (k + 1) * step].tobytes() for k in range(PARTS)], pa.binary())], schema=schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<u4") for x in pdf.counts], axis=0, dtype="<u8")
        return pd.DataFrame({"part": pdf.part.iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    sums = docs.select(C.text_of().alias("text")).mapInArrow(run, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()  # SLOTS numbers
    return np.concatenate([np.frombuffer(bytes(r.counts), "<u4") for r in sorted(sums)]) if sums else np.zeros(SLOTS, "<u4")


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(13)).astype("i8") & (SLOTS - 1)


def _prefixes(docs: DataFrame) -> DataFrame:
    """g, s, n, at: a set's prefix shingles, its hash, its size and the shingle's place."""
    sent = docs.sparkSession.sparkContext.broadcast(_counted(docs))
    shape = "g long, s long, n int, at int"
    schema = C.arrow(shape)

    def run(batches):
        times = sent.value

        def prefix(t):
            if not (n := len(s := shingles(t))):
                return np.zeros((4, 0), "i8")
            first = s[np.lexsort((s, times[_slot(s)]))][: n - (4 * n + 4) // 5 + 1].view("i8")
            m = len(first)
            return np.stack([first, np.full(m, _name(s), "u8").view("i8"), np.full(m, n), np.arange(m)])

        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), BATCH):
                g, s, n, at = np.concatenate([prefix(t) for t in texts[k : k + BATCH]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(n.astype("i4")), pa.array(at.astype("i4"))], schema=schema)

    return docs.where("doc_id is not null").select(C.text_of().alias("text")).mapInArrow(run, shape)


def _possible(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m shingles whose first common one is at these places can have similarity 0.8."""
    return 9 * F.least(n - at, m - to) >= 4 * (n + m)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _near(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the sets whose fingerprints are within simhash.RADIUS bits, materialised."""
    sets = nodes.where("n > 0").select("fp", "sim")
    fps = C.cut(sets.groupBy("sim").agg(F.min("fp").alias("rep")), "fingerprints")
    same = sets.join(fps, "sim").where("fp <> rep").select(*_pair("fp", "rep"))
    return C.cut(same.unionByName(simhash.links(fps.select(F.col("sim").alias("fp"), "rep")).select(*_pair("a", "b"))).distinct(), "near")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than sets of similarity 0.8 do in shingles."""
    both = pairs
    for x in "ab":
        both = both.join(nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return C.cut(both.where(9 * bits <= F.col("na") + F.col("nb")).select("a", "b"), "alike")


def _similar(docs: DataFrame, names: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least 0.8, materialised."""
    pairs = _alike(pairs, nodes)
    ids = C.cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "fp"), "tried")
    one = names.where("doc_id is not null").join(ids, "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h")).select("h").distinct()
    one = F.broadcast(one) if ids.count() <= BROADCAST else one
    schema = pa.schema([("fp", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), BATCH):
                sets = [shingles(t) for t in texts[k : k + BATCH]]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_name(s) for s in sets], "u8").view("i8")), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))], schema=schema)

    texts = _text(docs).join(one, "h", "left_semi").select("h", "text").dropDuplicates(["h"]).select("text")
    sets = C.cut(texts.mapInArrow(run, "fp long, set array<long>"), "verify")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    links = C.cut(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "similar")
    for used in (pairs, ids, sets):
        C.discard(used)
    C.tidy(docs.sparkSession)
    return links


def classes(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(fp, component_id) of the sets in names(doc_id, h, fp), which is _named(docs). Tables are deleted when they have been used."""
    spark = docs.sparkSession
    nodes = C.cut(names.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("n", "sim", "sketch"))), "nodes")

    def rooted(links: DataFrame) -> DataFrame:
        by_rep = links.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("p")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("q")), "b")
        roots = components(by_rep.select(F.col("p").alias("a"), F.col("q").alias("b")))
        return C.cut(nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "rooted")

    tried = _near(nodes)
    links = _similar(docs, names, nodes, tried)
    so_far = rooted(links)
    C.tidy(spark)

    # The shingle's foremost member is its middle: it has the fewest shingles of its own before.
    row, foremost = F.struct("s", "n", "at"), (F.col("at") / F.col("n"), F.col("s"))
    meets = _prefixes(docs).withColumn("m", F.first(row).over(Window.partitionBy("g").orderBy(*foremost)))
    meets = C.cut(meets.where("s <> m.s").distinct(), "meets")
    C.tidy(spark)
    star = meets.where(_possible(F.col("m.n"), F.col("m.at"), F.col("n"), F.col("at"))).select(*_pair("m.s", "s")).distinct()
    for x in "ab":
        star = star.join(so_far.select(F.col("fp").alias(x), F.col("component_id").alias(f"c{x}")), x)
    star = C.cut(star.where("ca <> cb").select("a", "b").join(tried, ["a", "b"], "left_anti"), "star")
    tried = C.cut(tried.unionByName(star), "tried")
    found = _similar(docs, names, nodes, star)
    if not found.isEmpty():
        links = links.unionByName(found)
        so_far = rooted(links)
    members = C.cut(meets.select("g", "s", "n", "at").unionByName(meets.select("g", "m.*").distinct()), "members")
    C.discard(meets)
    C.tidy(spark)
    for last in (*ROUNDS, None):
        now = members.drop("c", "place").join(so_far.select(F.col("fp").alias("s"), F.col("component_id").alias("c")), "s")
        # Shingles of one passage have the same members, and a pair is tried by one shingle as well as by all: of shingles whose
        # members agree, by their number and two hashes, one stays: the first in the order, where all their pairs have the most still to come.
        like = now.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.sum(F.xxhash64("s", F.lit(1)).cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(2))).alias("y"), F.min_by("at", "s").alias("first"))
        open_ = like.where("lo <> hi").groupBy("k", "x", "y").agg(F.min_by("g", "first").alias("g")).select("g")
        now = now.join(open_, "g", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*foremost)))
        old, members = members, C.cut(now, "members")
        C.discard(old)
        C.tidy(spark)
        if members.isEmpty():
            break
        first = members if last is None else members.where(F.col("place") <= last)
        first = first.select("g", *(F.col(x).alias(f"{x}_") for x in ("s", "n", "at", "c", "place")))
        more = members.join(first, "g").where((F.col("place") > F.col("place_")) & (F.col("c") != F.col("c_")) & _possible(F.col("n"), F.col("at"), F.col("n_"), F.col("at_")))
        more = C.cut(more.select(*_pair("s_", "s")).distinct().join(tried, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            tried = C.cut(tried.unionByName(more), "tried")
            found = _similar(docs, names, nodes, more)
            if not found.isEmpty():
                links = links.unionByName(found)
                so_far = rooted(links)
        if last is not None and members.where(F.col("place") > last + 1).isEmpty():
            break  # no shingle has more members: all pairs have been tried
        C.tidy(spark)
    return so_far


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; rows without doc_id stay.

    Null and blank texts, which have no shingles, are one component. Of repeated rows of a doc_id one stays, the same
    in each run. An empty table stays empty. Columns of docs may have any names.
    """
    names = _named(docs)
    return one_of_each(docs, names.select("doc_id", "h", "fp"), classes(docs, names))
