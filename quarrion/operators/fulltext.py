"""A stored full-text index of immutable segments: block-wise top-k search, phrases by columns, incremental updates.

Tables of a store, each a list of parts, one a segment:

* fts.docs (segment, doc, view_id, id, source_file, dl, stems): a row a chunk. Documents are numbered without gaps within a segment.
* fts.blocks (segment, view_id, term, shift, block, n, peaks, docs, tfs, dls): postings of a stem, cut into ranges of document numbers:
  block = doc >> shift, with the shift chosen so that a block holds about BLOCK postings. So hot stems are many rows, and the block
  that would hold a given document is known without looking. peaks are the (tf, dl) pairs that no other pair of the block
  beats in both, so the block's largest share of a score is exact whatever the statistics become.
* fts.positions (segment, view_id, word, col, doc, positions): of words as written, by column; delta-coded by the file format.
* fts.terms, fts.views, fts.words: counts that add up. A removal appends negative ones.
* fts.dead (segment, doc): removed documents, until a merge drops them. fts.files (path, hash, on, at): which files are in, the last entry holds.

Top-k search prunes with the running k-th score of each prompt (MaxScore): stems whose largest shares can't lift a document over it
don't bring candidates, nor do blocks that can't; the rest of a candidate's score is looked up in the blocks that would hold its number, in turns
between which candidates drop out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion import config
from quarrion.functions import text as T
from quarrion.operators.common import small, stored
from quarrion.operators.search import folded_stem, idf, summed, top_hits
from quarrion.sources.store import Conflict, Snapshot, Store

#: Postings of a block, about; segments of a size that are merged into one, how sizes grow, and the share of removed documents that asks for a merge.
BLOCK, FANOUT, GROWTH, DEAD = 128, 4, 4, 0.25
#: Most blocks of a stem that are read whole for the first bound of a prompt's k-th score; slack for sums in another order.
SEED_BLOCKS, SLACK = 4, 1e-6
#: Turns in which the other stems of candidates are looked up, TURN stems a turn, the last turn all that are left.
TURNS, TURN = 4, 1
ONE_BLOCK = 62
#: Occurrences that a task groups at once, and words whose stems it keeps.
OCCURRENCES, STEMS = 500_000, 500_000
KEY = ["segment", "view_id", "term", "block"]
TABLES = {
    "docs": "segment string, doc long, view_id string, id string, source_file string, dl long, stems array<string>",
    "blocks": "segment string, view_id string, term string, shift int, block long, n int, peaks array<struct<tf: double, dl: long>>, docs array<long>, tfs array<double>, dls array<long>",
    "positions": "segment string, view_id string, word string, col string, doc long, positions array<int>",
    "terms": "view_id string, term string, df long",
    "views": "view_id string, n long, dl long",
    "words": "view_id string, word string, n long",
    "dead": "segment string, doc long",
    "files": "path string, hash string, on boolean, at long",
}


@dataclass
class Index:
    """One snapshot of the index. views(view_id, n, avgdl) is small: a row a view."""

    snapshot: Snapshot
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.snapshot.read(f"fts.{name}", TABLES[name])
        return self.tables[name]

    def statistics(self) -> DataFrame:
        return self.views.groupBy("view_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("_dl")).where("n > 0").select("view_id", "n", (F.col("_dl") / F.col("n")).alias("avgdl"))

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows(segment, doc, ...) without removed documents."""
        return rows.join(small(self.dead), ["segment", "doc"], "left_anti") if self.snapshot.tables.get("fts.dead") else rows


def opened(store: Store, generation: int | None = None) -> Index:
    return Index(store.snapshot(generation))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocked(tf: DataFrame, terms: DataFrame, span: int, segment: str) -> DataFrame:
    """Blocks of tf(view_id, term, doc, tf, dl); terms(view_id, term, df); span: the documents' numbers are that many."""
    # df > BLOCK holds for a small share of the stems, yet it may be many: broadcast only after a look.
    shift = F.greatest(F.floor(F.log2(F.lit(float(max(span, 1))) * BLOCK / F.col("df"))), F.lit(0)).cast("int")
    hot = small(terms.where(F.col("df") > BLOCK).select("view_id", "term", shift.alias("shift")))
    rows = tf.join(hot, ["view_id", "term"], "left").withColumn("shift", F.coalesce("shift", F.lit(ONE_BLOCK)))
    post = F.struct("doc", "tf", "dl")
    got = rows.groupBy("view_id", "term", "shift", F.expr("shiftright(doc, shift)").alias("block")).agg(F.sort_array(F.collect_list(post)).alias("p"))
    best = F.sort_array(F.transform("p", lambda x: F.struct((-x["tf"]).alias("tf"), x["dl"].alias("dl"))))
    none = F.array().cast("array<struct<tf: double, dl: long>>")
    peaks = F.aggregate(best, none, lambda s, x: F.when((F.size(s) == 0) | (x["dl"] < F.element_at(s, -1)["dl"]), F.concat(s, F.array(F.struct((-x["tf"]).alias("tf"), x["dl"].alias("dl"))))).otherwise(s))
    each = lambda c: F.transform("p", lambda x: x[c]).alias(f"{c}s")
    out = got.select(F.lit(segment).alias("segment"), "view_id", "term", "shift", "block", F.size("p").alias("n"), peaks.alias("peaks"), each("doc"), each("tf"), each("dl"))
    return out.sortWithinPartitions("term", "view_id", "block")


def build(store: Store, chunks: DataFrame, first: int = 0, columns: dict[str, float] | None = None) -> tuple[str, int, dict[str, str]]:
    """(segment, documents, paths by table) of a new segment with chunks(view_id, id, source_file and some of the columns), written but not committed.

    Texts are tokenised once, into a staging table that goes at the end. What a chunk's words are counted by lies in the chunk's own row, so
    occurrences aren't shuffled: only postings are, once, into blocks, and counts. Documents get the numbers from `first` on.
    """
    segment = uuid.uuid4().hex
    columns = {c: w for c, w in (columns or config.COLUMN_WEIGHTS).items() if c in chunks.columns}
    path = lambda name: store.place(segment, name)
    split = chunks.select("view_id", "id", "source_file", F.monotonically_increasing_id().alias("m"), F.array(*(T.words(F.concat_ws(" ", F.col(c))) for c in columns)).alias("t"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in split.schema if f.name != "t")
    staged = _write(split.mapInArrow(_grouped(list(columns.values())), f"{kept}, dl long, stems array<string>, tfs array<double>, held array<struct<word: string, col: int, positions: array<int>>>"), path("staged"))
    sizes = sorted((r.k, r.n) for r in staged.groupBy(F.shiftright("m", 33).alias("k")).agg(F.count("*").alias("n")).collect())  # a row a task
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, first + total))
        total += n
    begin = F.broadcast(store.spark.createDataFrame(starts, "_k long, _s long"))
    docs = staged.withColumn("_k", F.shiftright("m", 33)).join(begin, "_k").withColumn("doc", F.col("_s") + F.col("m").bitwiseAND((1 << 33) - 1))
    _write(docs.select(F.lit(segment).alias("segment"), "doc", "view_id", "id", "source_file", "dl", "stems"), path("docs"))
    _write(staged.groupBy("view_id").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")), path("views"))
    col = F.get(F.array(*map(F.lit, columns)), F.col("x.col")).alias("col")
    at = docs.select("view_id", "doc", F.explode("held").alias("x")).select(F.lit(segment).alias("segment"), "view_id", "x.word", col, "doc", "x.positions")
    at = _write(at.sortWithinPartitions("word", "view_id", "doc"), path("positions"))
    _write(at.groupBy("view_id", "word").agg(F.count("*").alias("n")), path("words"))
    terms = _write(staged.select("view_id", F.explode("stems").alias("term")).groupBy("view_id", "term").agg(F.count("*").alias("df")), path("terms"))
    tf = docs.select("view_id", "doc", "dl", F.explode(F.arrays_zip("stems", "tfs")).alias("x")).select("view_id", F.col("x.stems").alias("term"), "doc", F.col("x.tfs").alias("tf"), "dl")
    _write(_blocked(tf, terms, total, segment), path("blocks"))
    store.delete(path("staged"))
    return segment, total, {n: path(n) for n in ("docs", "blocks", "positions", "terms", "views", "words")}


def _grouped(weights: list[float]) -> Callable:
    """Rows with t, the words of each column, to rows with dl, stems and weighted counts, and each column's words with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, c, known = np.array(weights), len(weights), {}

        def stem(word: str) -> str:
            if word not in known:
                if len(known) > STEMS:
                    known.clear()
                known[word] = folded_stem(word)
            return known[word]

        def lists(of: np.ndarray, n: int, values: pa.Array) -> pa.Array:
            """values, whose rows of n are `of`, ascending, as an array a row."""
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)), values)

        for batch in batches:
            sizes = pc.list_value_length(batch.column("t").flatten()).to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, c).sum(axis=1)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // OCCURRENCES)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(begin, end - begin)
                n, cells = part.num_rows, part.column("t").flatten()
                size = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
                words = cells.flatten().dictionary_encode()
                names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
                v = max(len(names), 1)
                cell = np.repeat(np.arange(n * c), size)
                position = np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size)
                key = cell * v + code
                order = np.argsort(key, kind="stable")
                key, starts = np.unique(key[order], return_index=True)
                times = np.diff(np.r_[starts, len(order)])
                of = key // v
                places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), pa.array(position[order].astype(np.int32)))
                held = pa.StructArray.from_arrays([names.take(pa.array(key % v)), pa.array((of % c).astype(np.int32)), places], ["word", "col", "positions"])
                stems = pa.array([stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
                s = max(len(stems.dictionary), 1)
                both, inverse = np.unique(of // c * s + stems.indices.to_numpy().astype(np.int64)[key % v], return_inverse=True)
                tf = np.bincount(inverse, weights=weight[of % c] * times, minlength=len(both))
                kept = [part.column(x) for x in part.schema.names if x != "t"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(size.reshape(n, c).sum(axis=1)), lists(both // s, n, stems.dictionary.take(pa.array(both % s))), lists(both // s, n, pa.array(tf)), lists(of // c, n, held)],
                    [*(x for x in part.schema.names if x != "t"), "dl", "stems", "tfs", "held"],
                )

    return run


def _with(s: Snapshot, paths: dict[str, str]) -> dict[str, list[str]]:
    return {f"fts.{n}": [*s.tables.get(f"fts.{n}", []), p] for n, p in paths.items()}


def create(store: Store, chunks: DataFrame, columns: dict[str, float] | None = None) -> Index:
    """Index chunks(view_id, id, source_file and the columns) of a store without an index."""
    s = store.snapshot()
    segment, n, paths = build(store, chunks, 0, columns)
    s.commit(parts=_with(s, paths), segments={segment: n}, next_doc=n)
    return opened(store)


def apply(store: Store, gone: DataFrame, files: DataFrame, chunker: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int | None:
    """Remove the files gone(source_file), and add or replace files(path, hash, text, ...), whose chunks chunker makes: one segment, one commit.

    Files of unchanged hash are skipped. What is written grows with the batch: the segment, a list of removed documents, and negative counts. batch
    (stream, number): skipped if it was committed before. The index's columns are those of chunker's rows that have a weight. The generation, or None.
    """
    for _ in range(5):
        s = store.snapshot()
        done = s.about.get("batches", {})
        if batch and done.get(batch[0], -1) >= batch[1]:
            return None
        known = s.read("fts.files", TABLES["files"])
        now = known.groupBy("path").agg(F.max_by("hash", "at").alias("hash"), F.max_by("on", "at").alias("on")).where("on").select("path", "hash")
        fresh = stored(files.join(now, ["path", "hash"], "left_anti"))
        lost = gone.select("source_file").distinct()
        touched = small(lost.unionByName(fresh.select(F.col("path").alias("source_file"))).distinct())
        at = F.lit(s.generation + 1).cast("long")
        log = fresh.select("path", "hash", F.lit(True).alias("on"), at.alias("at")).unionByName(lost.select(F.col("source_file").alias("path"), F.lit(None).cast("string").alias("hash"), F.lit(False).alias("on"), at.alias("at")))
        ix = Index(s)
        old = stored(ix.alive(ix.docs).join(touched, "source_file", "left_semi"))
        first = int(s.about.get("next_doc", 0))
        segment, n, paths = build(store, chunker(fresh), first)
        _write(old.select("segment", "doc"), store.place(segment, "dead"))
        _write(old.groupBy("view_id").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("dl")), store.place(segment, "views-"))
        _write(old.select("view_id", F.explode("stems").alias("term")).groupBy("view_id", "term").agg((-F.count("*")).alias("df")), store.place(segment, "terms-"))
        _write(log, store.place(segment, "files"))
        parts = _with(s, paths | {"dead": store.place(segment, "dead"), "files": store.place(segment, "files")})
        for name in ("views", "terms"):
            parts[f"fts.{name}"].append(store.place(segment, f"{name}-"))
        try:
            return s.commit(parts=parts, segments=s.about.get("segments", {}) | {segment: n}, next_doc=first + n, **({"batches": done | {batch[0]: batch[1]}} if batch else {}))
        except Conflict:
            store.delete(store.place(segment))
    raise Conflict("other writers came first, again and again")


def due(sizes: dict[str, int], dead: dict[str, int]) -> set[str]:
    """The segments to merge next: FANOUT of a size (powers of GROWTH), the smallest first; else those with many removed documents."""
    by: dict[int, list[str]] = {}
    for name, n in sizes.items():
        by.setdefault(int(math.log(max(n, 1), GROWTH)), []).append(name)
    for k in sorted(by):
        if len(by[k]) >= FANOUT:
            return set(by[k])
    return {name for name, n in sizes.items() if dead.get(name, 0) > DEAD * max(n, 1)}


def merge(store: Store) -> set[str]:
    """Merge segments that are due into one, without their removed documents, and add up counts; the segments that were merged. A merge that another
    writer overtakes is given up, and comes again with the next."""
    s = store.snapshot()
    sizes = s.about.get("segments", {})
    ix = Index(s)
    dead = {r.segment: r.n for r in ix.dead.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a segment
    chosen = due(sizes, dead)
    if not chosen:
        return set()
    segment = uuid.uuid4().hex
    path = lambda name: store.place(segment, name)
    inside = lambda paths: [p for p in paths if p.split("/")[-2] in chosen]
    outside = lambda name: [p for p in s.tables.get(f"fts.{name}", []) if p.split("/")[-2] not in chosen]
    def mine(name: str) -> DataFrame:
        reader = store.spark.read.schema(TABLES[name])
        found = inside(s.tables.get(f"fts.{name}", []))
        return reader.parquet(*found) if found else store.spark.createDataFrame([], TABLES[name])

    docs = _write(ix.alive(mine("docs")).withColumn("segment", F.lit(segment)), path("docs"))
    span = docs.agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).first()
    _write(ix.alive(mine("positions")).withColumn("segment", F.lit(segment)).sortWithinPartitions("word", "view_id", "doc"), path("positions"))
    posts = mine("blocks").select("segment", "view_id", "term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select("segment", "view_id", "term", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
    posts = ix.alive(posts).drop("segment")
    _write(_blocked(posts, posts.groupBy("view_id", "term").agg(F.count("*").alias("df")), (span.b - span.a + 1) if span.n else 1, segment), path("blocks"))
    for name, key, values in (("terms", ["view_id", "term"], ["df"]), ("views", ["view_id"], ["n", "dl"])):
        _write(mine(name).groupBy(*key).agg(*(F.sum(v).alias(v) for v in values)).where(" OR ".join(f"{v} <> 0" for v in values)), path(name))
    _write(store.spark.read.schema(TABLES["positions"]).parquet(path("positions")).groupBy("view_id", "word").agg(F.count("*").alias("n")), path("words"))
    # Removals that these segments brought, of documents in others; what they say of files, the last of each.
    _write(mine("dead").where(F.col("segment").isin([x for x in sizes if x not in chosen])), path("dead"))
    _write(mine("files").groupBy("path").agg(F.max_by(F.struct("hash", "on", "at"), "at").alias("r")).select("path", "r.*"), path("files"))
    parts = {f"fts.{n}": [*outside(n), path(n)] for n in TABLES}
    try:
        s.commit(parts=parts, segments={k: n for k, n in sizes.items() if k not in chosen} | {segment: span.n})
    except Conflict:
        store.delete(store.place(segment))
        return set()
    return chosen


def _posts(blocks: DataFrame) -> DataFrame:
    """(segment, view_id, term, block, doc, part) of blocks with idf and avgdl."""
    p = blocks.select("segment", "view_id", "term", "block", "idf", "avgdl", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    return p.select("segment", "view_id", "term", "block", F.col("p.docs").alias("doc"), share(F.col("idf"), F.col("p.tfs"), F.col("p.dls"), F.col("avgdl")).alias("part"))


def share(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a stem adds to a score."""
    return idf_ * tf * (config.K1 + 1) / (tf + config.K1 * (1 - config.B + config.B * dl / avgdl))


def _known(ix: Index, wanted: DataFrame) -> DataFrame:
    """(view_id, term, idf, avgdl) of the wanted(term) that a view holds."""
    known = ix.terms.join(wanted, "term", "left_semi").groupBy("view_id", "term").agg(F.sum("df").alias("df")).where("df > 0")
    return known.join(F.broadcast(ix.statistics()), "view_id").select("view_id", "term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")  # a row a view


def parts(ix: Index, terms: DataFrame) -> DataFrame:
    """(view_id, id, term, part): what each of the stems terms(term) adds to the score of each chunk that holds it. Prompts play no
    part, so several term sets can share one pass over the postings."""
    stats = stored(_known(ix, terms.select("term").distinct()))
    posts = ix.alive(_posts(ix.blocks.select(*KEY, "docs", "tfs", "dls").join(stats, ["view_id", "term"])))
    return posts.join(ix.docs.select("segment", "doc", "id"), ["segment", "doc"]).select("view_id", "id", "term", "part")


def found(ix: Index, terms: DataFrame) -> DataFrame:
    """(prompt_id, view_id, id, score, n_terms) of all chunks that hold any of the prompts' stems terms(prompt_id, term)."""
    return summed(parts(ix, terms), terms)


#: Up to so many postings of all prompts are scored outright; beyond, blocks are ruled out first. The rows are the same.
OUTRIGHT = 20_000_000


def best(ix: Index, terms: DataFrame, k: int) -> DataFrame:
    """The rows of top(), by whichever way costs less: few postings are scored in one pass, which blocks can't shorten much."""
    asked = stored(terms.select("prompt_id", "term").where("term is not null").distinct())
    df = ix.terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    if (asked.join(df, "term").agg(F.sum("df")).first()[0] or 0) > OUTRIGHT:
        return top(ix, asked, k).rows
    return top_hits(found(ix, asked).withColumn("_s", F.col("score")).withColumn("score", F.round("score", 9)), k).withColumn("score", F.col("_s")).drop("_s")


@dataclass
class Top:
    """rows (prompt_id, view_id, id, score, n_terms, rank); reads (prompt_id, n_read, n_blocks): blocks looked at, and those of its stems."""

    rows: DataFrame
    reads: DataFrame


def top(ix: Index, terms: DataFrame, k: int) -> Top:
    """The k best chunks of each prompt of terms(prompt_id, term), stems; ranked from 0, ties (scores rounded to 9 digits) by id.

    Scores equal those of scoring every chunk with any of the stems. A prompt without hits has no rows.
    """
    asked = stored(terms.select("prompt_id", "term").where("term is not null").distinct())
    stats = _known(ix, asked.select("term").distinct())
    largest = F.array_max(F.transform("peaks", lambda x: share(F.col("idf"), x["tf"], x["dl"], F.col("avgdl"))))
    heads = stored(ix.blocks.select(*KEY, "shift", "n", "peaks").join(stats, ["view_id", "term"]).select(*KEY, "shift", "n", "idf", "avgdl", largest.alias("ub")))
    full, one = ix.blocks.select(*KEY, "docs", "tfs", "dls"), ["prompt_id", "view_id", "segment", "doc"]

    def posts(keys: DataFrame) -> DataFrame:
        some = heads.join(keys.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "idf", "avgdl")
        return ix.alive(_posts(full.join(some, KEY)))

    def kth(sums: DataFrame) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("sum")))
        best = sums.select("prompt_id", "sum", rn.alias("_rn")).where(F.col("_rn") <= k)  # each task keeps k a prompt
        return best.groupBy("prompt_id").agg(F.count("*").alias("_n"), F.min("sum").alias("bound")).where(F.col("_n") == k).select("prompt_id", "bound")

    # A first bound: the k-th of the sums over all blocks of stems with few, and one of each other.
    best_first = F.row_number().over(Window.partitionBy("view_id", "term").orderBy(F.desc("ub"), "segment", "block"))
    most = heads.groupBy("view_id", "term").agg(F.max("ub").alias("most"), F.count("*").alias("n_blocks"))
    seeds = heads.withColumn("_rn", best_first).where(F.col("_rn") <= SEED_BLOCKS).join(most, ["view_id", "term"])
    seeds = stored(seeds.where((F.col("_rn") == 1) | (F.col("n_blocks") <= SEED_BLOCKS)).select(*KEY))
    seen = posts(seeds).join(asked, "term").groupBy(*one).agg(F.sum("part").alias("sum"))
    bound = kth(seen)
    # Stems that bring candidates: those whose shares, with all smaller ones, reach the bound. Blocks: those that reach it with all other stems.
    w = Window.partitionBy("prompt_id", "view_id")
    ranked = asked.join(most, "term").join(bound, "prompt_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    ranked = stored(ranked.withColumn("total", F.sum("most").over(w)).withColumn("up_to", F.sum("most").over(w.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))))
    bring = ranked.where(F.col("up_to") + SLACK >= F.col("bound")).join(heads.select(*KEY, "ub"), ["view_id", "term"]).where(F.col("ub") + F.col("total") - F.col("most") + SLACK >= F.col("bound"))
    bring = stored(bring.select("prompt_id", *KEY))
    # Stems that aren't read whole, the largest share first: what they may still add, and the turn in which they are looked up.
    whole = bring.groupBy("prompt_id", "view_id", "term").agg(F.count("*").alias("_read"))
    rest = ranked.join(whole, ["prompt_id", "view_id", "term"], "left").where(F.coalesce("_read", F.lit(0)) < F.col("n_blocks"))
    rest = rest.withColumn("_o", F.row_number().over(w.orderBy(F.desc("most"), "term")) - 1).withColumn("turn", F.least(F.floor(F.col("_o") / TURN).cast("int"), F.lit(TURNS - 1)))
    rest = stored(rest.select("prompt_id", "view_id", "term", "most", "turn"))
    after = [rest.where(F.col("turn") >= t).groupBy("prompt_id", "view_id").agg(F.sum("most").alias("_left")) for t in range(TURNS)]
    shifts = heads.select("segment", "view_id", "term", "shift").distinct()

    def open_(sums: DataFrame, turn: int) -> DataFrame:
        """The candidates that can still be among the k best."""
        x = sums.join(kth(sums), "prompt_id", "left")
        if turn < TURNS:
            x = x.join(after[turn], ["prompt_id", "view_id"], "left")
        left = F.coalesce("_left", F.lit(0.0)) if turn < TURNS else F.lit(0.0)
        return stored(x.where(F.col("sum") + left + SLACK >= F.coalesce("bound", F.lit(0.0))).select(*one, "sum", "n_terms"))

    sums = stored(posts(bring).join(bring, KEY).groupBy(*one).agg(F.sum("part").alias("sum"), F.count("*").alias("n_terms")))
    looked = []
    for t in range(TURNS):
        sums = open_(sums, t)
        # The blocks that would hold the candidates' numbers.
        at = sums.select(*one).join(rest.where(F.col("turn") == t), ["prompt_id", "view_id"]).join(shifts, ["segment", "view_id", "term"]).withColumn("block", F.expr("shiftright(doc, shift)"))
        at = at.select("prompt_id", *KEY, "doc").join(bring, ["prompt_id", *KEY], "left_anti").join(heads.select(*KEY), KEY, "left_semi")
        at = stored(at)
        looked.append(at.select("prompt_id", *KEY))
        more = posts(at).join(at, [*KEY, "doc"]).select(*one, F.col("part").alias("sum"), F.lit(1).cast("long").alias("n_terms"))
        sums = stored(sums.unionByName(more).groupBy(*one).agg(F.sum("sum").alias("sum"), F.sum("n_terms").alias("n_terms")))
    named = open_(sums, TURNS).join(ix.docs.select("segment", "doc", "id"), ["segment", "doc"])
    order = Window.partitionBy("prompt_id").orderBy(F.desc("_r"), "id")
    rows = named.withColumn("_r", F.round("sum", 9)).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    pairs = bring.unionByName(asked.join(seeds, "term").select("prompt_id", *KEY))
    for x in looked:
        pairs = pairs.unionByName(x)
    every = asked.join(heads, "term").groupBy("prompt_id").agg(F.count("*").alias("n_blocks"))
    reads = every.join(pairs.distinct().groupBy("prompt_id").agg(F.count("*").alias("n_read")), "prompt_id", "left").select("prompt_id", F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_blocks")
    return Top(rows.select("prompt_id", "view_id", "id", F.col("sum").alias("score"), "n_terms", F.col("rank").cast("long").alias("rank")), reads)


def phrases(ix: Index, asked: DataFrame) -> DataFrame:
    """(prompt_id, view_id, id) of the chunks in which the words of asked(prompt_id, words array, col string) follow one another in the
    column; in any one column where col is null. No text is read.

    A view's rarest word of the phrase brings the documents; the other words' positions are looked at in these only.
    """
    q = stored(asked.where(F.size("words") > 0).select("prompt_id", "words", F.col("col").cast("string").alias("want")))
    each = q.select("prompt_id", "want", F.size("words").alias("m"), F.posexplode("words").alias("k", "word"))
    wanted = small(each.select("word").distinct())
    counts = ix.words.join(wanted, "word", "left_semi").groupBy("view_id", "word").agg(F.sum("n").alias("n"))
    distinct = q.select("prompt_id", F.size(F.array_distinct("words")).alias("m"), F.explode(F.array_distinct("words")).alias("word")).distinct()  # a phrase may be asked of several columns
    # A view that lacks one of the words has no hit.
    per = distinct.join(small(counts), "word").groupBy("prompt_id", "view_id").agg(F.count("*").alias("have"), F.first("m").alias("m"), F.min(F.struct("n", "word")).alias("r")).where("have = m")
    rare = stored(per.select("prompt_id", "view_id", F.col("r.word").alias("word")))
    some = ix.positions.join(wanted, "word", "left_semi").join(small(rare.select("view_id").distinct()), "view_id", "left_semi")
    held = some.join(small(rare), ["view_id", "word"]).join(small(q.select("prompt_id", "want")), "prompt_id").where(F.col("want").isNull() | (F.col("want") == F.col("col")))
    places = stored(ix.alive(held.select("prompt_id", "view_id", "segment", "doc", "col").distinct()))
    near = some.join(small(places.select("segment", "doc", "col").distinct()), ["segment", "doc", "col"], "left_semi")
    at = near.join(places, ["view_id", "segment", "doc", "col"]).join(small(each.drop("want")), ["prompt_id", "word"])
    start = at.select("prompt_id", "m", "view_id", "segment", "doc", "col", "k", F.explode("positions").alias("p"))
    found = start.groupBy("prompt_id", "m", "view_id", "segment", "doc", "col", (F.col("p") - F.col("k")).alias("s")).agg(F.count_distinct("k").alias("have")).where("have = m")
    return found.select("prompt_id", "view_id", "segment", "doc").distinct().join(ix.docs.select("segment", "doc", "id"), ["segment", "doc"]).select("prompt_id", "view_id", "id").distinct()
