"""Fusing ranked lists, judging confidence, and bringing vector and graph candidates in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion import config
from quarrion.operators.common import top


#: Query vectors that are sent at once, and cells (query, vector) that a task scores at once.
QUERIES, CELLS = 4096, 1 << 20


def merge_unique(lists: DataFrame) -> DataFrame:
    """One row a chunk and list: scores of repeated hits add up."""
    return lists.groupBy("prompt_id", "strategy", "weight", "id").agg(F.sum("score").alias("score"))


def ranked(lists: DataFrame) -> DataFrame:
    """Rank from 0 within each list, by score, ties by id."""
    w = Window.partitionBy("prompt_id", "strategy").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def rrf(lists: DataFrame, k: int = config.RRF_K, trace: bool = False) -> DataFrame:
    """(prompt_id, id, score): 100 * the sum over lists of weight / (k + rank + 1); with trace, also what each list gave."""
    r = ranked(merge_unique(lists.where("weight > 0"))).withColumn("part", F.col("weight") / (k + F.col("rank") + 1) * 100)
    aggs = [F.sum("part").alias("score")]
    if trace:
        aggs.append(F.array_sort(F.collect_list(F.struct("strategy", "rank", "weight", "part"))).alias("contributions"))
    return r.groupBy("prompt_id", "id").agg(*aggs)


def entity_scores(matches: DataFrame) -> DataFrame:
    """(prompt_id, id, score): 0.5 for a chunk's first matched entity and 0.15 for each further one."""
    return scored_entities(matches.groupBy("prompt_id", "id").agg(F.count("*").alias("n")))


def scored_entities(counts: DataFrame) -> DataFrame:
    """entity_scores() of counts(prompt_id, id, n)."""
    return counts.select("prompt_id", "id", (0.5 + 0.15 * (F.col("n") - 1)).alias("score"))


def confidence(hits: DataFrame, prompts: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """(prompt_id, n, best, margin, low): low if there are no hits, or no exact identifier among the five best and a
    weak best or a close second. exact: (prompt_id, id) of hits that match an identifier."""
    r = top(hits, ["prompt_id"], [F.desc("score"), "id"], 5, "rank")
    e = r.join(exact.withColumn("hit", F.lit(True)), ["prompt_id", "id"], "left") if exact is not None else r.withColumn("hit", F.lit(None).cast("boolean"))
    n = hits.groupBy("prompt_id").agg(F.count("*").alias("n"))
    per = e.groupBy("prompt_id").agg(F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("second"), F.coalesce(F.max("hit"), F.lit(False)).alias("exact")).join(n, "prompt_id")
    per = prompts.select("prompt_id").join(per, "prompt_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    margin = F.when(F.col("n") >= 2, (F.col("best") - F.col("second")) / F.col("best"))
    low = (F.col("n") == 0) | (~F.coalesce("exact", F.lit(False)) & ((F.col("best") < 8) | F.coalesce(margin < 0.15, F.lit(False))))
    return per.select("prompt_id", "n", "best", margin.alias("margin"), low.alias("low"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 15) -> DataFrame:
    """(prompt_id, id, score, rank): exact top k by dot product of vectors(id, embedding) for queries(prompt_id, q).

    Queries are sent in blocks of QUERIES; each task's vectors meet a block in matrix products of CELLS cells, and the task gives its k best,
    so that what is shuffled is k rows a query and task, not a row a pair.
    """
    spark = vectors.sparkSession
    q = queries.select("prompt_id", "q").where("q is not null").withColumn("_b", F.pmod(F.xxhash64("prompt_id"), F.lit(-(-max(queries.count(), 1) // QUERIES))))
    found = None
    for b in sorted(r[0] for r in q.select("_b").distinct().collect()):
        rows = sorted(tuple(r) for r in q.where(F.col("_b") == b).select("prompt_id", "q").collect())  # QUERIES, about
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype="f8")))
        part = vectors.where("embedding is not null").select("id", "embedding").mapInPandas(_best(sent, k), f"prompt_id {dict(q.dtypes)['prompt_id']}, id {dict(vectors.dtypes)['id']}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = vectors.limit(0).crossJoin(q.limit(0))
        found = none.select("prompt_id", "id", F.lit(0.0).alias("score"))
    return top(found, ["prompt_id"], [F.desc("score"), "id"], k, "rank")


def _best(sent, k: int):
    """A task's k best of each query. Cells (query, vector) are scored CELLS at a time and meet the best so far, so memory is bounded by these."""

    def run(batches):
        names, q = sent.value
        best = None
        step = max(1, CELLS // max(len(names), 1))
        for pdf in batches:
            all_ids = pdf.id.to_numpy()
            for first in range(0, len(pdf), step):
                v = np.stack(pdf.embedding.iloc[first : first + step].to_numpy()).astype("f8")
                score = np.round(q @ v.T, 9)
                ids = np.broadcast_to(all_ids[first : first + step], score.shape)
                if best is not None:
                    score, ids = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], ids], axis=1)
                order = np.lexsort((ids, -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)
        if best is not None:
            yield pd.DataFrame({"prompt_id": np.repeat(names, best[0].shape[1]), "id": best[1].ravel(), "score": best[0].ravel()})

    return run


def embedding_agreement(direct: DataFrame, near: DataFrame, low: DataFrame) -> DataFrame:
    """direct with boosted scores where the vectors agree; for low-confidence prompts, up to five vector-only hits more."""
    both = direct.join(near.select("prompt_id", "id", F.col("rank").alias("v")), ["prompt_id", "id"], "left")
    boosted = both.select("prompt_id", "id", F.when(F.col("v") < 10, F.col("score") * (1.2 + 0.5 / (1 + F.col("v")))).otherwise(F.col("score")).alias("score"), F.when(F.col("v") < 10, "boost").otherwise("keep").alias("action"))
    only = near.join(direct, ["prompt_id", "id"], "left_anti").join(low.where("low").select("prompt_id"), "prompt_id", "left_semi")
    only = top(only, ["prompt_id"], ["rank"], 5, "i")
    added = only.select("prompt_id", "id", F.greatest(F.lit(8.0), 14 - 1.5 * F.col("i")).alias("score"), F.lit("insert").alias("action"))
    return boosted.unionByName(added)


def merge_expanded(direct: DataFrame, expanded: DataFrame) -> DataFrame:
    """Direct hits and graph hits; one that is both gains 1.5 times its graph score."""
    d, e = direct.select("prompt_id", "id", F.col("score").alias("d")), expanded.select("prompt_id", "id", F.col("score").alias("e"))
    both = d.join(e, ["prompt_id", "id"], "full_outer")
    return both.select("prompt_id", "id", F.coalesce(F.col("d") + 1.5 * F.col("e"), F.col("d"), F.col("e")).alias("score"))
