"""Mixture-controlled packing: deficit round-robin over source queues fills every window.

Every source has a queue of its documents' ids and a target share, by default its share of all tokens.
Each window (a sequence) adds its share to each source's deficit; sources with a positive
deficit are then served in turn, a piece of at most PIECE ids at a time, and what is served
comes off the deficit, which may go below zero and is carried to the next window. When only
overdrawn sources are left, the one nearest to its target is served, so windows are full. The
work is dealt over parts of the documents; a part begins with the deficits that the parts
before it leave, which follow from their token counts alone, so parts are packed in parallel
and still carry. Only a part's last window is padded.
"""

from __future__ import annotations

import zlib
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.llm import bitplane
from quarrion.llm import common as C

LENGTH = 1024
PIECE = 256
#: Bytes of text a part, least and most: its ids, at most one a byte, are held in memory when it is packed. The least is some 1000
#: sequences, so that a part's last, which is padded, and its documents' sources are a small share of it.
LEAST_BYTES, PART_BYTES = 4 << 20, 64 << 20
#: Parts that a table of middling size gets; a smaller one has fewer, a larger one more.
PARTS = 1024
SHAPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def n_parts(size: int) -> int:
    """Parts of a table with so many bytes of text."""
    each = min(max(size // PARTS, LEAST_BYTES), PART_BYTES)
    return max(1, -(-size // each))


def encode_parts(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Encode documents(doc_id, text, source) into one bit-plane file a part; returns (part, path, source, tokens), materialised.

    Parts are dealt by row, so that each has a like mix and a source or repeated document of any size is spread.
    Their number follows from the bytes of text alone, whatever the session's shuffle partitions.
    """
    n = n_parts(docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"), F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("_i"))
    d = d.repartition(n, "_i").sortWithinPartitions("_i").drop("_i")
    shape = "part long, path string, source string, tokens long"
    schema = C.arrow(shape)

    def write(batches):
        part, slices = TaskContext.get().partitionId(), bitplane.encode_batches(batches, tokenizer, end_id, special_as_text)
        if (first := next(slices, None)) is None:
            return
        uri, tokens = f"{folder}/part-{part:06d}.qpl", {}
        with C.atomic_file(uri) as out:
            w = bitplane.Writer(out)
            for (doc_ids, sources), ids, counts in chain([first], slices):
                w.add(doc_ids, counts, ids, sources)
                for s, n in zip(sources, counts.tolist(), strict=True):
                    tokens[s] = tokens.get(s, 0) + n
            w.close()
        yield pa.RecordBatch.from_pydict({"part": [part] * len(tokens), "path": [uri] * len(tokens), "source": list(tokens), "tokens": list(tokens.values())}, schema)

    return C.cut(d.mapInArrow(write, shape), "parts")


def planned(parts: DataFrame, length: int = LENGTH, weights: dict[str | None, float] | None = None) -> DataFrame:
    """A row a part: path, first sequence_id, and its sources with share and deficit at its begin.

    The deficit before a part is share * (tokens of all parts before) - (the source's tokens there): prefix sums
    over parts, by source. weights: target shares by source instead of those in the data.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    p = parts.withColumn("k", key)
    total = p.groupBy("part", "path").agg(F.sum("tokens").alias("all"))
    by = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    total = C.cut(total.withColumn("first", F.coalesce(F.sum(F.ceil(F.col("all") / length)).over(by), F.lit(0)).cast("long")).withColumn("before", F.coalesce(F.sum("all").over(by), F.lit(0))), "part-sums")
    shares = p.groupBy("k").agg(F.sum("tokens").alias("s"))
    if weights:
        pairs = [("~" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        shares = shares.join(p.sparkSession.createDataFrame(pairs, "k string, w double"), "k", "left").select("k", F.coalesce("w", F.lit(0.0)).alias("s"))
    sum_ = shares.agg(F.sum("s")).first()[0] or 1
    shares = shares.select("k", (F.col("s") / F.lit(float(sum_))).alias("share"))
    served = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("served", F.coalesce(F.sum("tokens").over(served), F.lit(0))).join(shares, "k").join(total, ["part", "path"])
    state = F.struct("k", "share", (F.col("share") * F.col("before") - F.col("served")).alias("deficit"))
    return C.cut(p.groupBy("part", "path", "first").agg(F.sort_array(F.collect_list(state)).alias("sources")), "part-plan")


def packed(queues: dict, shares: dict, deficits: dict, first: int, length: int, piece: int):
    """Pieces (doc, start, ids, doc tokens, sequence, offset, source) of a part.

    queues: source -> deque of (doc, ids). Deficits may be of any sign; they're updated.
    """
    order = sorted(queues)
    turn, sequence = 0, first
    heads = {s: 0 for s in order}  # ids already taken of a queue's first document
    while order:
        room, last = length, None
        for s in order:
            deficits[s] += shares[s] * length
        idle = 0
        while room and order:
            turn %= len(order)
            s = order[turn]
            if deficits[s] <= 0 and idle < len(order):
                turn, idle = turn + 1, idle + 1
                continue
            if deficits[s] <= 0:  # all are overdrawn: the one nearest to its target
                s = max(order, key=lambda x: (deficits[x], x))
                turn = order.index(s)
            idle = 0
            doc, ids = queues[s][0]
            at = heads[s]
            n = min(len(ids) - at, room, piece)
            if last and last[0] is ids and last[1] + last[2] == at:
                last[2] += n
            else:
                if last:
                    yield last[4], last[1], last[0][last[1] : last[1] + last[2]], len(last[0]), sequence, last[3], last[5]
                last = [ids, at, n, length - room, doc, s]
            deficits[s] -= n
            room -= n
            if at + n == len(ids):
                queues[s].popleft()
                heads[s] = 0
                if not queues[s]:
                    order.remove(s)
                    continue
            else:
                heads[s] = at + n
            turn += 1
        if last:
            yield last[4], last[1], last[0][last[1] : last[1] + last[2]], len(last[0]), sequence, last[3], last[5]
        sequence += 1


def pack(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, tokenizer: str | None = None, weights: dict[str | None, float] | None = None, special_as_text: bool = False) -> DataFrame:
    """A row a piece of documents(doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Null text: the end id alone. Null sources are one queue. Null ids and repeated rows are documents like others.
    An empty table gives an empty result. Sequences hold `length` ids, but for each part's last. Strings of special tokens are
    encoded as in bitplane.token_files. Columns of docs with the result's names, or any others, aren't read.
    """
    spark = docs.sparkSession
    folder = C.fresh_folder(spark, "packing")
    plan = planned(encode_parts(docs, folder, tokenizer, 0, special_as_text), length, weights)
    schema = C.arrow(SHAPE)

    def run(batches):
        for b in batches:
            for uri, first, sources in zip(*(c.to_pylist() for c in b.columns), strict=True):
                queues: dict[str, deque] = {x["k"]: deque() for x in sources}
                for doc, _, ids, note in bitplane.open_file(uri).documents():
                    queues["~" if note is None else f"={note}"].append((doc, ids))
                rows = []
                for doc, start, ids, n, sequence, at, s in packed(queues, {x["k"]: x["share"] for x in sources}, {x["k"]: x["deficit"] for x in sources}, first, length, piece):
                    rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), n, sequence, at, None if s == "~" else s[1:]))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return C.a_task_each(plan.select("path", "first", "sources"), "first").select("path", "first", "sources").mapInArrow(run, SHAPE)
