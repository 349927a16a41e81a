"""SimHash near-duplicates with BK-trees.

Distinct fingerprints, each with its smallest doc_id, are the nodes. For a radius of 2 the
64 bits are cut into blocks: two fingerprints that differ in 2 bits or fewer agree on all
blocks but two at least, so each fingerprint goes to the shard of every choice of all blocks but two,
and every linked pair meets in one. A shard's tree is built where its fingerprints are, one
shuffle of 24-byte rows, instead of broadcasting trees that grow with the corpus. In a
BK-tree a node's children are keyed by their integer Hamming distance to it, and a search
follows only the edges within the radius of its own distance. A shard reports a spanning
forest, not pairs. The first level has 4 blocks. Shards of over DENSE fingerprints are cut again,
into 8 and then 16 blocks; a shard of the last level has 8 bits open, so its tree has 256 nodes at most.
"""

from __future__ import annotations

from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C
from quarrion.llm.components import components

RADIUS = 2
#: Blocks by level, and the fingerprints above which a shard goes to the next.
LEVELS = (4, 8, 16)
DENSE = 2048
#: Dense shards (16 bytes each) up to which their keys are broadcast; beyond, they're joined by shuffle.
DENSE_SENT = 1 << 20
#: Shingles that are hashed and counted at a time.
CHUNK = 1 << 16


class BKTree:
    def __init__(self):
        self.codes: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        at = 0
        if self.codes:
            while True:
                d = (code ^ self.codes[at]).bit_count()
                if d == 0:
                    return
                if (kid := self.kids[at].get(d)) is None:
                    break
                at = kid
            self.kids[at][d] = len(self.codes)
        self.codes.append(code)
        self.kids.append({})

    def near(self, code: int, radius: int) -> list[int]:
        """Places, in order of adding, of all codes within the radius."""
        found, open_ = [], [0] if self.codes else []
        while open_:
            at = open_.pop()
            d = (code ^ self.codes[at]).bit_count()
            if d <= radius:
                found.append(at)
            if kids := self.kids[at]:
                if len(kids) <= 2 * radius + 1:
                    open_ += [k for e, k in kids.items() if d - radius <= e <= d + radius]
                else:
                    open_ += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Over words of the text with A-Z lower-cased; 0 if it has none."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, CHUNK):
        some = words[k : min(k + CHUNK, n) + shingle - 1]
        parts = zip(*(some[j:] for j in range(shingle)), strict=False) if len(words) >= shingle else [words]
        ones += _ones(np.array([xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts], dtype="<u8"))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingles by their 64-bit hashes; 0 if there are none."""
    return _majority(sum((_ones(hashes[k : k + CHUNK]) for k in range(0, len(hashes), CHUNK)), np.zeros(64, dtype=np.int64)), len(hashes))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and h (XXH64 of the text, to find the row again), materialised."""
    shape = "doc_id long, h long, fp long"
    schema = C.arrow(shape)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype="u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], schema=schema)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(C.text_of()).alias("h"), C.text_of().alias("text"))
    return C.cut(text.mapInArrow(run, shape), "fingerprints")


def _keys(blocks: int, radius: int) -> list[tuple[int, int]]:
    """(number, mask) of each choice of blocks - radius blocks of bits."""
    width = 64 // blocks
    whole = [((1 << width) - 1) << (width * k) for k in range(blocks)]
    return [(i, sum(c)) for i, c in enumerate(combinations(whole, blocks - radius))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(rows: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """(rep, smallest rep) of the fingerprints (fp, rep) that the tree links to others, but for the smallest."""
    tree, root = BKTree(), list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (fp, _) in enumerate(rows):
        for j in tree.near(fp, radius):
            a, b = find(i), find(j)
            if a != b:
                small, large = (a, b) if rows[a][1] < rows[b][1] else (b, a)
                root[large] = small
        tree.add(fp)
    return [(rows[i][1], rows[find(i)][1]) for i in range(len(rows)) if find(i) != i]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between rep ids of nodes(fp, rep), with distinct fp, that connect all within the radius (2 at most)."""
    if not 0 < radius <= 2:
        raise ValueError("the radius is 1 or 2")
    out, left = None, nodes
    for level, blocks in enumerate(LEVELS):
        shards = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in _keys(blocks, radius))))
        keyed = left.withColumn("k", shards).select("k.i", "k.v", "fp", "rep")
        dense = None
        if level + 1 < len(LEVELS):
            dense = C.cut(keyed.groupBy("i", "v").count().where(F.col("count") > DENSE).select("i", "v"), "dense")
            n = dense.count()
            keys = F.broadcast(dense) if n <= DENSE_SENT else dense
            open_ = keyed.join(keys, ["i", "v"], "left_anti") if n else keyed
        else:
            n, open_ = 0, keyed
        found = C.cut(_trees(open_, radius), "links")
        out = found if out is None else out.unionByName(found)
        if not n:
            break
        left = C.cut(keyed.join(keys, ["i", "v"], "left_semi").select("fp", "rep").distinct(), "dense-nodes")
    return out


def _trees(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) found by a tree for each shard (i, v) of keyed(i, v, fp, rep)."""
    rows_ = keyed.repartition("i", "v").sortWithinPartitions("i", "v", "fp")
    shape = "a long, b long"
    schema = C.arrow(shape)

    def search(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []
        for _, shard in groupby(rows(), key=lambda r: r[:2]):
            first = next(shard)
            if (second := next(shard, None)) is None:
                continue
            held = [(x[2] & (1 << 64) - 1, x[3]) for x in chain([first, second], shard)]  # DENSE, or 256, at most
            out += _forest(held, radius)
            if len(out) >= 50_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return rows_.mapInArrow(search, shape)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of the fingerprints in rows(doc_id, fp)."""
    nodes = C.cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, radius))
    return nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of documents(doc_id, text).

    Null and blank texts have fingerprint zero and link like others. A repeated doc_id is one
    node a fingerprint. Rows whose doc_id is null get a fingerprint and the component of their
    equals, or null if they have none, but link nothing themselves. No rows give no rows.
    """
    rows = fingerprints(docs, shingle)
    found = _joined(rows, _classes(rows, radius))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(fp, ...) with their component_id; a fingerprint that many rows share is dealt over pieces."""
    hot = C.cut(rows.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > C.hot_limit(rows.count())), "hot")
    return C.salted_join(rows, classes, "fp", hot)


def one_of_each(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with one row of each component, by rows(doc_id, h, fp) and classes(fp, component_id); docs' columns may have any names."""
    kept = _joined(rows, classes).where("doc_id = component_id")
    # Two texts under one doc_id in one component: the smaller hash stays.
    kept = C.cut(kept.groupBy("doc_id").agg(F.min("h").alias("h"), F.count("*").alias("n")), "kept")
    id_ = F.col("doc_id").cast("long")
    whole = docs.select(F.struct(*C.same_columns(docs)).alias("row"), id_.alias("doc_id"), F.xxhash64(C.text_of()).alias("h"))
    stay = whole.join(kept, ["doc_id", "h"])
    once = stay.where("n = 1").select("row.*")
    if not kept.where("n > 1").isEmpty():  # repeated rows: the first by their values as JSON
        once = once.unionByName(stay.where("n > 1").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return once.unionByName(docs.where(id_.isNull()))


def deduplicated(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; rows without doc_id stay.

    Null and blank texts are one component. Of repeated rows of a doc_id one stays, the same in each run. An empty
    table stays empty. Columns of docs may have any names.
    """
    rows = fingerprints(docs, shingle)
    return one_of_each(docs, rows, _classes(rows, radius))
