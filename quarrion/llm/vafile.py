"""Exact top-k search by vector-approximation files.

Vectors are scaled to integers. A file holds segments; a segment has its vectors' ids, their
cells (each dimension's range cut into 2**BITS equal parts, so BITS bits a component), the
cells' bounds, and the exact vectors. A search scans the cells alone: they give a lower and an upper
bound of each inner product, and a vector whose upper bound is under the k-th largest lower bound is
out. Of the rest, exact vectors are read in order of upper bound until the k-th best
score is certain. Queries go in blocks of BLOCK; a task searches a group of files for a block, and where there are
several groups, so that few queries keep all cores busy, their best are merged. What a task holds is
bounded: when more than HELD candidates wait, they are resolved, exactly, and the scan goes on
with the better bound.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quarrion.llm import common as C

SCALE = 64
BITS = 4
SEGMENT = 8192
BLOCK = 256
HELD = 1 << 21
#: Exact vectors that are read a query and round.
ROUND = 64
#: Components are held within these bounds, so that they fit 64 bits.
MOST = 2.0**62


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their floor(SCALE * x) as 64-bit integers, short vectors padded with zeros)."""
    lists = column.to_pylist() if not isinstance(column, pa.ListArray) else None
    if lists is None:
        lists = column
        flat, ends = column.flatten(), np.diff(column.offsets.to_numpy())
        good = np.ones(len(column), bool) if column.null_count == 0 else ~column.is_null().to_numpy(zero_copy_only=False)
        if column.null_count == 0 and flat.null_count == 0 and len(ends) and (ends == ends[0]).all() and ends[0]:
            x = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)
            good = np.isfinite(x).all(axis=1)
            return np.nonzero(good)[0], np.floor(np.clip(SCALE * x[good], -MOST, MOST)).astype("i8")
        lists = column.to_pylist()
    keep = [i for i, v in enumerate(lists) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.zeros((len(keep), max((len(lists[i]) for i in keep), default=0)))
    for k, i in enumerate(keep):
        x[k, : len(lists[i])] = lists[i]
    return np.array(keep, dtype="i8"), np.floor(np.clip(SCALE * x, -MOST, MOST)).astype("i8")


def widened(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integers, exact; beyond 64 bits, the nearest that fits."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    sums = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums], dtype="i8")


def write_files(vectors: DataFrame, folder: str, bits: int = BITS) -> DataFrame:
    """Write a file a partition of vectors(vec_id, embedding); manifest (path, n), materialised."""
    shape = "path string, n long"
    schema = C.arrow(shape)

    def write(batches):
        uri, n, at, index = f"{folder}/va-{TaskContext.get().partitionId():06d}.bin", 0, 0, []
        with C.atomic_file(uri) as out:
            for b in batches:
                ids, rows = b.column(0).to_numpy(zero_copy_only=False), integers(b.column(1))
                for k in range(0, len(rows[0]), SEGMENT):
                    part, x = ids[rows[0][k : k + SEGMENT]].astype("<i8"), rows[1][k : k + SEGMENT]
                    low = x.min(axis=0) if x.shape[1] else np.zeros(0, "i8")
                    span = np.maximum(x.max(axis=0).astype(object) - low.astype(object), 0) if x.shape[1] else np.zeros(0, object)
                    width = np.array([-(-(int(s) + 1) // (1 << bits)) for s in span], dtype="u8")
                    cells = ((x.astype("u8") - low.astype("u8")) // np.maximum(width, 1)).astype(np.uint8)
                    if bits <= 4:
                        cells = np.pad(cells, ((0, 0), (0, cells.shape[1] % 2)))
                        cells = cells[:, ::2] | cells[:, 1::2] << 4
                    kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.abs(x.astype("f8")).max(initial=0) < 2 ** (8 * int(t[2]) - 1) - 1)
                    places = []
                    for a in (part, low.astype("<i8"), width.astype("<u8"), np.ascontiguousarray(cells), x.astype(kind)):
                        out.write(a.tobytes())
                        places.append(at)
                        at += a.nbytes
                    index.append({"n": len(part), "d": x.shape[1], "bits": bits, "kind": kind, "at": places})
                    n += len(part)
            tail = json.dumps(index).encode()
            out.write(tail + len(tail).to_bytes(8, "little"))
        if n:
            yield pa.RecordBatch.from_pydict({"path": [uri], "n": [n]}, schema)

    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return C.cut(rows.mapInArrow(write, shape), "va-files")


class Segment:
    """One segment of a file; reads its parts when asked to."""

    def __init__(self, source, about: dict):
        self.source, self.n, self.d, self.bits, self.kind = source, about["n"], about["d"], about["bits"], about["kind"]
        self.at = about["at"]

    def _read(self, k: int, kind: str, count: int, skip: int = 0) -> np.ndarray:
        size = np.dtype(kind).itemsize
        self.source.seek(self.at[k] + skip * size)
        return np.frombuffer(self.source.read(count * size), dtype=kind)

    def ids(self) -> np.ndarray:
        return self._read(0, "<i8", self.n)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest value of each vector's cells, as floats."""
        low, width = self._read(1, "<i8", self.d).astype("f8"), self._read(2, "<u8", self.d).astype("f8")
        if self.bits <= 4:
            half = -(-self.d // 2)
            packed = self._read(3, "u1", self.n * half).reshape(self.n, half)
            cells = np.empty((self.n, 2 * half), np.uint8)
            cells[:, ::2], cells[:, 1::2] = packed & 15, packed >> 4
            cells = cells[:, : self.d]
        else:
            cells = self._read(3, "u1", self.n * self.d).reshape(self.n, self.d)
        least = low + cells * width
        return least, least + np.maximum(width - 1, 0)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        if len(rows) * 16 >= self.n:
            return self._read(4, self.kind, self.n * self.d).reshape(self.n, self.d)[rows].astype("i8")
        return np.stack([self._read(4, self.kind, self.d, int(r) * self.d) for r in rows]).astype("i8")


def segments_of(paths: list[str]):
    for uri in paths:
        fs, path = C.file_system(uri)
        size = fs.get_file_info(path).size
        source = fs.open_input_file(path)
        source.seek(size - 8)
        n = int.from_bytes(source.read(8), "little")
        source.seek(size - 8 - n)
        for about in json.loads(source.read(n)):
            yield Segment(source, about)


class Search:
    """Top k of a block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score = np.empty(0, "i8")
        self.query, self.vec = np.empty(0, "i8"), np.empty(0, "i8")
        self.floor = np.full(len(ids), -np.inf)
        self.low = np.full((len(ids), k), -np.inf)
        self.waiting: list[tuple] = []
        self.n_waiting = self.n_read = 0

    def scan(self, s: Segment) -> None:
        least, most = s.bounds()
        d = max(self.q.shape[1], s.d)
        q = widened(self.q, d).astype("f8")
        least, most = widened(least, d), widened(most, d)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        upper, lower = up @ most.T + down @ least.T, up @ least.T + down @ most.T
        if (big := max(np.abs(upper).max(initial=0), np.abs(lower).max(initial=0))) >= 2.0**52:  # sums of doubles are rounded there
            upper, lower = upper + big * 1e-12, lower - big * 1e-12
            upper, lower = np.clip(upper, -(2.0**63), 2.0**63), np.clip(lower, -(2.0**63), 2.0**63)
        ids = s.ids()
        own = self.ids[:, None] == ids[None, :]
        upper[own] = lower[own] = -np.inf
        m = min(self.k, s.n)
        best = np.concatenate([self.low, -np.partition(-lower, m - 1, axis=1)[:, :m]], axis=1)
        self.low = -np.partition(-best, self.k - 1, axis=1)[:, : self.k]
        self.floor = np.maximum(self.floor, self.low.min(axis=1))
        qi, ri = np.nonzero((upper >= self.floor[:, None]) & ~own)
        if len(qi):
            self.waiting.append((s, qi, ri, upper[qi, ri], ids[ri]))
            self.n_waiting += len(qi)
        if self.n_waiting > HELD:
            self.resolve()

    def resolve(self) -> None:
        """Read exact vectors of those that wait, by upper bound, until each query's k-th is certain."""
        if not self.waiting:
            return
        seg = np.concatenate([np.full(len(w[1]), i) for i, w in enumerate(self.waiting)])
        qi, ri, up, vid = (np.concatenate([w[j] for w in self.waiting]) for j in (1, 2, 3, 4))
        keep = up >= self.floor[qi]
        seg, qi, ri, up, vid = seg[keep], qi[keep], ri[keep], up[keep], vid[keep]
        order = np.lexsort((vid, -up, qi))
        seg, qi, ri, up, vid = seg[order], qi[order], ri[order], up[order], vid[order]
        begin = np.searchsorted(qi, np.arange(len(self.ids)))
        end = np.searchsorted(qi, np.arange(len(self.ids)), side="right")
        while True:
            take = [np.arange(b, min(b + ROUND, e)) for b, e in zip(begin, end, strict=True) if b < e]
            if not take:
                break
            t = np.concatenate(take)
            t = t[up[t] >= self.floor[qi[t]]]
            if len(t):
                score = np.empty(len(t), "i8")
                for g in np.unique(seg[t]):
                    m = np.nonzero(seg[t] == g)[0]
                    rows, back = np.unique(ri[t[m]], return_inverse=True)
                    x = self.waiting[g][0].exact(rows)
                    d = max(x.shape[1], self.q.shape[1])
                    x, q = widened(x, d), widened(self.q, d)
                    for c in range(0, len(m), 1 << 15):
                        some = m[c : c + (1 << 15)]
                        score[some] = products(q[qi[t[some]]], x[back[c : c + (1 << 15)]])
                self.n_read += len(t)
                self._merge(qi[t], score, vid[t])
            begin = np.minimum(begin + ROUND, end)
            # Of a query whose next bound is under its k-th score, nothing more can matter.
            live = begin < end
            live[live] = up[begin[live]] >= self.floor[live]
            begin = np.where(live, begin, end)
        self.waiting, self.n_waiting = [], 0

    def _merge(self, qi: np.ndarray, score: np.ndarray, vid: np.ndarray) -> None:
        query, all_, vec = np.concatenate([self.query, qi]), np.concatenate([self.score, score]), np.concatenate([self.vec, vid])
        order = np.lexsort((vec, ~all_, query))
        query, all_, vec = query[order], all_[order], vec[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        self.query, self.score, self.vec, self.rank = query[keep], all_[keep], vec[keep], rank[keep]
        full = self.rank == self.k - 1
        self.floor[self.query[full]] = np.maximum(self.floor[self.query[full]], self.score[full].astype("f8"))


def top_k(vectors: DataFrame, is_query, k: int = 20, bits: int = BITS, folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best by integer inner product, ties to the smaller vec_id.

    vectors(vec_id, embedding); is_query: the condition that makes a row a query. Rows with a null vec_id, a null
    vector, or null or non-finite components take no part; short vectors count as if padded with zeros. Rows
    with the query's own vec_id aren't its candidates, and a repeated query row is answered each time. Fewer
    candidates than k give fewer rows; an empty table gives an empty result; other columns aren't read. Scores beyond 64 bits are held at the largest or smallest long, and tie there.
    """
    spark = vectors.sparkSession
    paths = sorted(r.path for r in write_files(vectors, folder or C.fresh_folder(spark, "va"), bits).collect())
    shape = "query_id long, rank int, vec_id long, score long, _q long"
    schema = C.arrow(shape)
    queries = vectors.where("vec_id is not null").where(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = C.cut(queries.withColumn("_q", F.monotonically_increasing_id()), "va-queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = max(1, min(len(paths), -(-tasks(spark) // blocks)))
    turn = F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int") * groups
    dealt = queries.withColumn("_t", F.explode(F.sequence(turn, turn + groups - 1))).repartitionByRange(blocks * groups, "_t").sortWithinPartitions("_t")

    def search(batches):
        rows = pa.Table.from_batches(batches, pa_queries)  # a block or so
        turns = rows.column("_t").to_numpy()
        for t in np.unique(turns):
            first, last = np.searchsorted(turns, [t, t + 1])
            for at in range(first, last, BLOCK):
                yield from answered(rows.slice(at, min(BLOCK, last - at)).combine_chunks(), paths[int(t) % groups :: groups])

    def answered(part: pa.Table, files: list[str]):
        rows, q = integers(part.column("embedding").chunk(0))
        if not len(rows):
            return
        s = Search(part.column("vec_id").to_numpy()[rows], q, k)
        for segment in segments_of(files):
            s.scan(segment)
        s.resolve()
        if len(s.query):
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[s.query]), pa.array((s.rank + 1).astype("i4")), pa.array(s.vec), pa.array(s.score), pa.array(part.column("_q").to_numpy()[rows][s.query])], schema=schema)

    pa_queries = to_arrow_schema(dealt.schema)
    found = dealt.mapInArrow(search, shape)
    if groups > 1:  # k rows a query and group
        by = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    return found.drop("_q")


def tasks(spark) -> int:
    """Tasks that keep the cluster's cores busy."""
    return 2 * spark.sparkContext.defaultParallelism
