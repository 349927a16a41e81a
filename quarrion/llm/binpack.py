"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

The unit of placement is a group of rows whose texts are equal. Groups are placed from the largest
down, each into the shard where the dot product of the group's vector with the shard's residual
capacity is highest. Groups of at least 1/HEAVY of the total in any dimension (3 * HEAVY at most) are placed
first, by the driver. What they leave of each shard is shared out over parts of the other groups, by the
parts' totals, so that parts are placed in parallel, group by group, each within its own residual
capacities; a part ends with its smallest groups, so its shards miss their share by about one of
those. A group of over 1/SPLIT of the total in some dimension can't sit in one shard without tilting it,
so its rows are dealt out, in turn, over enough pieces, and those are placed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.llm import common as C

HEAVY = 2048
SPLIT = 64
#: Groups a part, about; what a task holds of them is a few numbers each.
PART_GROUPS = 1 << 17


def place(items: np.ndarray, left: np.ndarray) -> list[int]:
    """A shard for each row of items (one column a dimension); left: residual capacities by shard, which are updated.

    Items that no shard has room for go where the worst overrun is least. Ties go to the
    lower shard; items of equal size keep their order.
    """
    out = [0] * len(items)
    for i in np.lexsort((np.arange(len(items)), -items.sum(axis=1), -items.max(axis=1, initial=0))):
        after = left - items[i]
        least = after.min(axis=1)
        fits = least >= 0
        score = np.where(fits, left @ items[i], -np.inf) if fits.any() else least
        out[i] = int(np.argmax(score))
        left[out[i]] = after[out[i]]
    return out


def _placed(light: DataFrame, left: np.ndarray, parts: int) -> DataFrame:
    """(_g, _light) of the groups light(_g, b, t, r), within the capacities `left` (shards by dimensions)."""
    share = np.maximum(left, 0)
    share = share / np.where(share.sum(axis=0) > 0, share.sum(axis=0), 1)  # of what is left, by shard
    share[:, share.sum(axis=0) == 0] = 1.0 / len(left)

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("_g")  # the same each time
        items = groups[["b", "t", "r"]].to_numpy(dtype=float)
        items = items / np.maximum(items.sum(axis=0), 1)
        return pd.DataFrame({"_g": groups["_g"], "_light": place(items, share.copy())})

    part = F.pmod(F.xxhash64("_g", F.lit(3)), F.lit(parts))
    return light.withColumn("_p", part).groupBy("_p").applyInPandas(run, "_g long, _light int")


def shards(docs: DataFrame, n_shards: int = 16, tokens: Column | None = None) -> DataFrame:
    """Assign documents(doc_id, text) to shards 0 to n_shards - 1; law: bytes.

    Returns doc_id, size (UTF-8 bytes of the text + 1), text_crc32, law, shard, slot (gapless
    from 0 in a shard) and grown_shard (null). tokens: the token dimension, by default the
    number of words. Null text: as empty. Null doc_ids and repeated rows are rows like
    others, and an empty table gives an empty result. Other columns, whatever their names, aren't read.
    """
    spark, text = docs.sparkSession, C.text_of()
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_g"),
        (tokens if tokens is not None else F.regexp_count(text, F.lit(C.WORD))).cast("long").alias("_tokens"),
        F.spark_partition_id().alias("_part"),
    )
    base = C.cut(base, "shard-rows")
    groups = base.groupBy("_g").agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r"))
    groups = C.cut(groups, "shard-groups")
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"), F.count("*").alias("n")).first()
    share = F.greatest(*(F.col(c) / F.lit(float(max(total[c], 1))) for c in "btr"))
    heavy = groups.where(share >= 1.0 / HEAVY).withColumn("pieces", F.when(share > 1.0 / SPLIT, F.least(F.ceil(share * HEAVY / 8), F.col("r"))).otherwise(F.lit(1)))
    rows = sorted(heavy.collect())  # 3 * HEAVY at most
    keys = [x["_g"] for x in rows for _ in range(x.pieces)]
    sizes = [[x[c] / x.pieces for c in "btr"] for x in rows for _ in range(x.pieces)]
    left = np.full((n_shards, 3), 1.0 / n_shards)
    at = place(np.array(sizes, dtype=float).reshape(-1, 3) / [max(total[c], 1) for c in "btr"], left)
    to: dict[int, list[int]] = {}
    for g, s in zip(keys, at, strict=True):
        to.setdefault(g, []).append(s)
    big = F.broadcast(spark.createDataFrame(list(to.items()), "_g long, _to array<int>"))
    parts = max(1, -(-total.n // PART_GROUPS), min(C.partitions(spark), total.n // 4096))
    light = C.cut(_placed(groups.where(share < 1.0 / HEAVY), left, parts), "shard-light")
    rows_ = base.join(big, "_g", "left")
    # A light group has under 1/HEAVY of the rows, so this join has no hot key.
    easy = rows_.where("_to is null").drop("_to").join(light, "_g").withColumnRenamed("_light", "shard")
    hard = rows_.where("_to is not null")
    turn = _numbered(hard, "_g", "doc_id")
    hard = turn.withColumn("shard", F.get("_to", (F.col("_k") % F.size("_to")).cast("int"))).drop("_to", "_k")
    numbered = _numbered(easy.unionByName(hard), "shard", "doc_id", "_g")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_k").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with _k: 0, 1, ... within each key. They're numbered within a key and part of the input, and parts follow one another."""
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "_part").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(within) - 1).join(counts, [key, "_part"]).withColumn("_k", (F.col("_from") + F.col("_i")).cast("long")).drop("_n", "_from", "_i")
