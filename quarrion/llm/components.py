"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two joins on the smallest neighbour, so nothing is collected for a node of any
degree; the edges of a hub are dealt over pieces. The number of rounds is logarithmic in practice;
lineage is cut after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C


def _star(edges: DataFrame, seen: DataFrame, rows: int) -> DataFrame:
    """seen: rows (u, v), v a neighbour of u; edges' u goes with m, the smallest of its neighbours and itself."""
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    least = C.cut(C.few_tasks(least, rows), "least")
    limit = C.hot_limit(least.agg(F.sum("n")).first()[0] or 0)
    return C.few_tasks(C.salted_join(edges, least.drop("n"), "u", least.where(F.col("n") > limit).select("u", "n")), rows)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges(a, b) that isn't its component's smallest: root is that one.

    Nodes are longs. Loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    n = e.count()
    e = C.cut(C.few_tasks(e.distinct(), n), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        old, large = e, C.cut(C.few_tasks(large, n), "large-star")
        pairs = F.explode(F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v"))))
        small = _star(large, large, n).select(pairs.alias("p")).select("p.*").where("u <> v").distinct()
        e = C.cut(C.few_tasks(small, n), "small-star")
        C.discard(old)
        C.discard(large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
