"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Each document i of source s gets a rate r_i, the one nearest to 1 in relative entropy under
sum(r_i * size_i) = target_s and r_i <= CAP. By duality r_i = min(CAP, exp(l_s * x_i)), where
x_i is the size over the source's mean size, and l_s solves a convex problem in one
variable a source. Newton steps run for all sources at once: a step is one aggregation over
the histogram of sizes, which is pre-aggregated, so that a source of any share costs no more.
A step that leaves the bracket known so far halves it instead. Sums are decimals, so that
their order doesn't matter and reruns agree. Rates are then rounded to copies: r_i is
rounded down, and the documents whose hash falls lowest against the remainder get one more,
up to a threshold that brings the source's words nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.llm import common as C

#: Weights by rank of the source, repeating, and the most that a document or source is repeated.
WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 60
TOLERANCE = 1e-6
BUCKETS = 4096
#: Up to so many sources the state (some 100 bytes a source) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with _size (words; null text: 0), _key (source, null kept apart) and _u (hash of id and text in [0, 1))."""
    text = C.text_of()
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.crc32(text), F.lit(7)), 11) / F.lit(float(1 << 53))
    return docs.withColumns({"_size": F.regexp_count(text, F.lit(C.WORD)).cast("long"), "_key": _key(), "_u": u})


def _ranked(per: DataFrame) -> DataFrame:
    """per with _rank: 0, 1, ... by code point, nulls last. Ranges of sources are numbered each in a task; one number a range goes to the driver."""
    d = per.repartitionByRange((F.col("_key") == "~").cast("int"), "_key").withColumn("_range", F.spark_partition_id())
    d = C.cut(d, "source-ranges")
    counts = sorted((r["_range"], r["count"]) for r in d.groupBy("_range").count().collect())
    begin, total = {}, 0
    for k, n in counts:
        begin[k] = total
        total += n
    if not begin:
        return d.withColumn("_rank", F.lit(0).cast("long")).drop("_range")
    first = F.element_at(F.create_map(*(F.lit(x) for k, n in begin.items() for x in (k, n))), F.col("_range"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy((F.col("_key") == "~").cast("int"), "_key"))
    return d.withColumn("_rank", (first + within - 1).cast("long")).drop("_range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_key, source_size, docs, target: the weights share the sum of all sizes; a target stops at
    CAP times its source's size, and the excess goes to the others by weight until none is above.

    One row a source, ranked by code point, nulls last. Each round of the filling is one aggregation; a
    round caps at least one source more, and few rounds are needed, as the level grows by the excess.
    """
    per = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    pick = F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int"))
    per = _ranked(per).withColumn("_w", pick.cast("double")).withColumn("_cap", (F.col("source_size") * CAP).cast("double")).drop("_rank")
    per = C.cut(per, "source-caps")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    full, level, n = 0.0, 0.0, -1
    while True:  # per holds the sources; full: what the capped ones take
        over = F.col("_cap") < F.col("_w") * F.lit(level)
        sums = per.agg(F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        full, rest = sums[0], sums[1]
        if sums[2] == n or rest <= 0:
            break
        n, level = sums[2], (total - full) / rest
    return per.withColumn("target", F.least("_cap", F.col("_w") * F.lit(level))).select("_key", "source_size", "docs", "target")


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def _rate(lam: Column, x: Column) -> Column:
    return F.when(lam * x >= F.lit(1.0986122886681098), F.lit(float(CAP))).otherwise(F.exp(F.greatest(lam * x, F.lit(-700.0))))


def solve(sizes: DataFrame, target: DataFrame) -> DataFrame:
    """_key, source_size, target, mean, lam: the dual's solution for each source."""
    hist = C.cut(sizes.where("_size > 0").groupBy("_key", "_size").agg(F.count("*").alias("n")), "sizes")
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))
    state = target.select("_key", "source_size", "target", mean.alias("mean"), *(F.lit(v).cast("double").alias(c) for c, v in (("lam", 0.0), ("lo", None), ("hi", None))))
    free = (F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size"))
    lam = F.when(free, F.col("lam")).otherwise(F.when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    done = state.where(~free).withColumn("lam", lam).select("_key", "source_size", "target", "mean", "lam")
    state, keys = C.cut(state.where(free), "dual"), ["_key", "source_size", "target", "mean", "lam", "lo", "hi"]
    for _ in range(STEPS):
        x = F.col("_size") / F.col("mean")
        rate = _rate(F.col("lam"), x)
        words = F.col("n") * F.col("_size") * rate
        sums = hist.join(state, "_key").groupBy(*keys).agg(_exact(words).alias("f"), _exact(F.when(rate < CAP, words * x).otherwise(0.0)).alias("g"))
        off = F.col("f") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("g") > 0, F.col("lam") - off / F.col("g"))
        inside = newton.isNotNull() & (newton > F.coalesce(lo, F.lit(float("-inf")))) & (newton < F.coalesce(hi, F.lit(float("inf"))))
        half = F.when(lo.isNull(), 2 * hi - 1).when(hi.isNull(), 2 * lo + 1).otherwise((lo + hi) / 2)
        near = F.abs(off) <= TOLERANCE * F.col("target")
        step = F.when(near, F.col("lam")).otherwise(F.when(inside, newton).otherwise(half))
        state = C.cut(sums.select("_key", "source_size", "target", "mean", step.alias("lam"), lo.alias("lo"), hi.alias("hi"), (~near).alias("_open")), "dual")
        if state.where("_open").isEmpty():
            break
    return state.select("_key", "source_size", "target", "mean", "lam").unionByName(done)


def _rounded(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """sizes joined with its source's state, with _base (whole copies) and _bucket (the order in which one more is given)."""
    lam, x = F.col("lam"), F.col("_size") / F.col("mean")
    rate = F.when(lam == float("inf"), F.lit(float(CAP))).when(lam == float("-inf"), F.lit(0.0)).otherwise(_rate(lam, x))
    d = sizes.join(state, "_key").withColumn("_rate", rate).withColumn("_base", F.floor("_rate").cast("int"))
    place = F.floor((F.col("_u") - (F.col("_rate") - F.col("_base")) + 1) * (BUCKETS // 2)).cast("int")
    return d.withColumn("_bucket", F.when(F.col("_base") < CAP, place).otherwise(BUCKETS))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_key, source_size, target, mean, lam, more: all that a document's copies follow from."""
    state = C.cut(solve(sizes, C.cut(targets(sizes, weights), "targets")), "solved")
    rounded = _rounded(sizes, _small(state))
    parts = rounded.groupBy("_key", "target", "_bucket").agg(F.sum(F.col("_base") * F.col("_size")).alias("_sure"), F.sum("_size").alias("_words"))
    by = Window.partitionBy("_key").orderBy("_bucket")
    have = F.sum("_sure").over(Window.partitionBy("_key")) + F.sum("_words").over(by)
    # A source has BUCKETS + 1 rows at most here. more = 0: no document gets one more.
    steps = parts.withColumn("_have", have).withColumn("_none", F.sum("_sure").over(Window.partitionBy("_key"))).where(F.col("_bucket") < BUCKETS)
    best = steps.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("_have") - F.col("target")).alias("d"), (F.col("_bucket") + 1).alias("more"))).alias("a"), F.min(F.abs(F.col("_none") - F.col("target"))).alias("z"))
    best = best.select("_key", F.when(F.col("z") <= F.col("a.d"), 0).otherwise(F.col("a.more")).alias("more"))
    return C.cut(state.join(best, "_key", "left").withColumn("more", F.coalesce("more", F.lit(0))), "mix-plan")


def _small(state: DataFrame) -> DataFrame:
    return F.broadcast(state) if state.count() <= BROADCAST_SOURCES else state


def copies(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """sizes with source_size, target and _copies (0 to CAP)."""
    d = _rounded(sizes, _small(planned))
    return d.withColumn("_copies", F.col("_base") + (F.col("_bucket") < F.col("more")).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of documents(doc_id, text, source).

    Null text: size 0. Null sources are one source, the last. A source without words has target 0.
    Rows with equal id and text share one fate. An empty table gives an empty result. Columns
    of docs that have the result's names aren't read.
    """
    sizes = C.cut(sized(docs.select("doc_id", "text", "source")).drop("text", "source"), "mix-rows")
    d = copies(sizes, plan(sizes, weights))
    return d.select("doc_id", F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("_copies") * F.col("_size")).cast("long").alias("taken"), F.col("_copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as in docs, whatever their names.

    Cases are as in mix(): null texts have no words and, as their rate isn't bound by a target, follow their source's;
    repeated rows share a fate, an empty table stays empty.
    """
    sizes = C.cut(sized(docs.select("doc_id", "text", "source")).drop("text", "source"), "mix-rows")
    whole = docs.select(F.struct(*C.same_columns(docs)).alias("row"), "doc_id", "text", "source")
    d = copies(sized(whole), plan(sizes, weights)).where("_copies > 0")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
