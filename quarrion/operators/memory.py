"""Facts, feedback, sessions, retention and usage figures. `as_of` is always given; nothing reads a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion import config
from quarrion.functions import text as T
from quarrion.operators.common import small, stored, top

DAY = 24 * 3600 * 1000


def adjustments(signals: DataFrame, limit: int = 5) -> DataFrame:
    """(key, adjustment): the sum of a key's signals, held within the limit once."""
    total = signals.groupBy("key").agg(F.sum("adjustment").alias("s"))
    return total.select("key", F.least(F.greatest("s", F.lit(-limit)), F.lit(limit)).cast("long").alias("adjustment"))


def file_importance(files: DataFrame, ratings: DataFrame) -> DataFrame:
    """files(path, importance) moved by +-1 a rating (path, up), held within 1 to 10."""
    n = ratings.groupBy("path").agg(F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("d"))
    moved = F.least(F.greatest(F.col("importance") + F.coalesce("d", F.lit(0)), F.lit(1)), F.lit(10))
    return files.join(n, "path", "left").withColumn("importance", moved).drop("d")


def learned(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts with new(fact, category, at): a known text gains 0.1 confidence a repetition, up to 1; others begin at 1.

    facts: fact, category, confidence, created_at, last_accessed, access_count.
    """
    n = new.groupBy("fact").agg(F.min_by("category", "at").alias("n_category"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    both = facts.join(n, "fact", "full_outer")
    old = F.col("confidence").isNotNull()
    return both.select(
        "fact",
        F.coalesce("category", "n_category").alias("category"),
        F.when(old, F.least(F.col("confidence") + 0.1 * F.coalesce("n", F.lit(0)), F.greatest("confidence", F.lit(1.0)))).otherwise(1.0).alias("confidence"),
        F.coalesce("created_at", "first").alias("created_at"),
        F.greatest("last_accessed", "last").alias("last_accessed"),
        F.coalesce("access_count", F.lit(0)).alias("access_count"),
    )


def decayed(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts unused for 7 days lose 0.05 confidence, down to 0.1; those under 0.15 and unused for 30 days go."""
    idle = as_of - F.col("last_accessed")
    lower = F.when(idle > 7 * DAY, F.greatest(F.col("confidence") - 0.05, F.least("confidence", F.lit(0.1)))).otherwise(F.col("confidence"))
    return facts.withColumn("confidence", lower).where(~((F.col("confidence") < 0.15) & (idle > 30 * DAY)))


def forgotten(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids, "id", "left_anti")


def accessed(facts: DataFrame, reads: DataFrame) -> DataFrame:
    """facts after reads(id, at): a search doesn't write; its reads are appended and counted here."""
    n = reads.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return facts.join(n, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "at")}).drop("n", "at")


def recent(events: DataFrame, n: int = 10) -> DataFrame:
    """The last n events of each session, with their place in time order."""
    last = top(events, ["session_id"], [F.desc("created_at"), F.desc("id")], n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")).cast("long"))


def retained(rows: DataFrame, as_of: Column, max_age_ms: int, max_count: int) -> DataFrame:
    """Rows young enough and among the newest max_count. The cut is found from counts by hour and then within one hour, so
    that rows aren't ordered in a single task."""
    young = rows.where(F.col("created_at") >= as_of - max_age_ms)
    hour = F.floor(F.col("created_at") / 3_600_000)
    per = young.groupBy(hour.alias("h")).agg(F.count("*").alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = per.select("h", (F.lit(max_count) - newer).alias("room"), "n").where("room > 0")
    kept = young.withColumn("h", hour).join(F.broadcast(room), "h")  # an hour a row
    whole = kept.where("room >= n").select(*rows.columns)
    last = top(kept.where("room < n"), ["h"], [F.desc("created_at"), F.desc("id")], max_count).withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("created_at"), F.desc("id"))))
    return whole.unionByName(last.where("k <= room").select(*rows.columns))


def next_after(events: DataFrame, gap_ms: int) -> DataFrame:
    """(user_id, at, next): each distinct event(user_id, at) with the user's first that is later by more than gap_ms; null if there is none.

    Times are cut into buckets of gap_ms. The time looked for lies in the bucket after an event's own: the next event is there, or it is the first of
    the next bucket that has any. So a task holds a bucket's events of a user, and a busy user is many tasks; what goes by user is a row a bucket.
    """
    e = events.where("at is not null").select("user_id", "at").distinct()
    bucket = lambda c: F.floor(c / gap_ms)
    probes = e.select("user_id", (F.col("at") + gap_ms).alias("v"), F.lit(1).alias("kind"), "at")
    both = e.select("user_id", F.col("at").alias("v"), F.lit(0).alias("kind"), "at").unionByName(probes).withColumn("b", bucket(F.col("v")))
    later = Window.partitionBy("user_id", "b").orderBy("v", "kind").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("near", F.min(F.when(F.col("kind") == 0, F.col("v"))).over(later)).where("kind = 1").select("user_id", "at", "b", "near")
    firsts = both.groupBy("user_id", "b").agg(F.min(F.when(F.col("kind") == 0, F.col("v"))).alias("f"))
    far = firsts.select("user_id", "b", F.min("f").over(Window.partitionBy("user_id").orderBy("b").rowsBetween(1, Window.unboundedFollowing)).alias("far"))
    return near.join(far, ["user_id", "b"]).select("user_id", "at", F.coalesce("near", "far").alias("next"))


def followed(pointers: DataFrame) -> DataFrame:
    """(user_id, at, k): what each user's first row reaches over pointers(user_id, at, next), and as the k-th. By doubling: after n rounds pointers
    span 2 ** n steps, and what is reached has doubled as often, so rounds are the logarithm of the longest chain."""
    jumps = stored(pointers)
    reached = stored(jumps.groupBy("user_id").agg(F.min("at").alias("at")).withColumn("k", F.lit(0).cast("long")))
    span = 1
    while True:
        more = stored(reached.join(jumps, ["user_id", "at"]).where("next is not null").select("user_id", F.col("next").alias("at"), (F.col("k") + span).alias("k")))
        if more.isEmpty():
            return reached
        reached = stored(reached.unionByName(more))
        half = jumps.select("user_id", F.col("at").alias("next"), F.col("next").alias("_n"))
        jumps = stored(jumps.join(half, ["user_id", "next"]).where("_n is not null").select("user_id", "at", F.col("_n").alias("next")))
        span *= 2


def rotated(events: DataFrame, max_age_ms: int = config.SESSION_MAX_MS) -> DataFrame:
    """(user_id, session, begins_at): sessions by age. One begins with the first event that is older than max_age_ms after the session's first.

    events: user_id, at. Null times don't count; a null user has no sessions.
    """
    return followed(next_after(events.where("user_id is not null"), max_age_ms)).select("user_id", F.col("k").alias("session"), F.col("at").alias("begins_at"))


def crowded(events: DataFrame, most: int, window_ms: int) -> DataFrame:
    """(user_id, begins_at, n): windows of at least `most` events(user_id, at). A window begins with the first event that is later by more than
    window_ms than the last one's begin, so it isn't tied to the clock.

    An event meets its window by buckets of window_ms: the window began in the event's own bucket or the one before.
    """
    e = events.where("user_id is not null and at is not null").select("user_id", "at").withColumn("b", F.floor(F.col("at") / window_ms))
    starts = rotated(events, window_ms).select("user_id", "begins_at", F.explode(F.array(F.floor(F.col("begins_at") / window_ms), F.floor(F.col("begins_at") / window_ms) + 1)).alias("b"))
    inside = e.join(starts, ["user_id", "b"]).where((F.col("at") >= F.col("begins_at")) & (F.col("at") <= F.col("begins_at") + window_ms))
    return inside.groupBy("user_id", "begins_at").agg(F.count("*").alias("n")).where(F.col("n") >= most)


def merged_memory(prompts: DataFrame, facts: DataFrame, events: DataFrame, policy: str = "relevant", cap: int = config.MEMORY_TOKENS) -> DataFrame:
    """(prompt_id, kind, id, score, tokens) of what memory adds to each prompt, within `cap` tokens; the first is always let in.

    prompts: prompt_id, terms, intent. facts: id, fact, confidence. events: id, event_type, content. With policy relevant, an
    item must share a term of over three letters; errors count for prompts that fix only; facts need 0.6 confidence.
    """
    none = prompts.limit(0).select("prompt_id", F.lit("").alias("kind"), F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("tokens"))
    if policy == "off":
        return none
    t = prompts.select("prompt_id", "intent", F.explode("terms").alias("term")).where(F.length("term") > 3)
    items = facts.where("confidence >= 0.6").select(F.lit("fact").alias("kind"), F.col("id").cast("string").alias("id"), F.col("fact").alias("content"), (F.col("confidence") * 10).alias("score"))
    items = items.unionByName(events.select(F.when(F.col("event_type") == "error", "error").otherwise("event").alias("kind"), F.col("id").cast("string").alias("id"), "content", F.lit(5.0).alias("score")))
    words = items.select("kind", "id", F.explode(F.array_distinct(T.words(F.col("content")))).alias("term"))
    # An item has a token at least, so a prompt takes `cap` items at most and looks at one more. Items of a kind and score that hold the same of all asked terms
    # come in the order of their ids with every prompt, so of each such group the first cap + 2 meet the prompts.
    asked = words.join(small(t.select("term").distinct()), "term").groupBy("kind", "id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    few = stored(top(items.select("kind", "id", "score").join(asked, ["kind", "id"]), ["kind", "score", "terms"], ["id"], cap + 2).select("kind", "id", "terms").distinct())
    shared = few.select("kind", "id", F.explode("terms").alias("term")).join(small(t), "term").groupBy("prompt_id", "kind", "id", "intent").agg(F.count("*").alias("shared"))
    if policy == "always":  # items have a token each at least, so no prompt takes more than the first of each kind
        first = items.where(F.length("content") > 0).orderBy(F.desc("score"), "kind", "id").limit(2 * cap + 2)
        other = items.where((F.length("content") > 0) & (F.col("kind") != "error")).orderBy(F.desc("score"), "kind", "id").limit(cap + 1)
        few = F.broadcast(first.unionByName(other).select("kind", "id").distinct())  # by the limits
        shared = prompts.select("prompt_id", "intent", F.lit(True).alias("_all")).join(few.withColumn("_all", F.lit(True)), "_all").drop("_all").withColumn("shared", F.lit(0))
    hits = shared.where((F.col("kind") != "error") | (F.col("intent") == "fix")).join(items, ["kind", "id"])
    hits = hits.withColumn("tokens", T.token_estimate(F.col("content"))).withColumn("score", F.col("score") + F.col("shared"))
    hits = top(hits, ["prompt_id"], [F.desc("score"), "kind", "id"], cap + 2)
    w = Window.partitionBy("prompt_id").orderBy(F.desc("score"), "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    sums = hits.withColumn("used", F.sum("tokens").over(w)).withColumn("k", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("score"), "kind", "id")))
    # The walk stops at the first item that doesn't fit, so a prefix sum decides it.
    fits = F.min(F.when((F.col("used") > cap) & (F.col("k") > 1), F.col("k"))).over(Window.partitionBy("prompt_id"))
    return sums.withColumn("stop", fits).where("stop is null or k < stop").select("prompt_id", "kind", "id", "score", "tokens")


def usage(prompts: DataFrame) -> DataFrame:
    """One row a store: count, sums and largest of tokens and latency."""
    return prompts.groupBy("store").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("max_tokens"), F.sum("latency").alias("latency"), F.max("latency").alias("max_latency"))


def layer_counts(rows: DataFrame, layers: tuple[str, ...] = ("global", "workspace", "repo", "session")) -> DataFrame:
    """A row a layer, zero where it has none."""
    dim = rows.sparkSession.createDataFrame([(x,) for x in layers], "layer string")
    return F.broadcast(dim).join(rows.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"))


def read_feedback(retrieved: DataFrame, reads: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Reads of a file within a time after its retrieval: (retrieved_id, read_id). Works on streams, with watermarks."""
    r = retrieved.select(F.col("id").alias("retrieved_id"), F.col("key").alias("r_key"), F.col("ts").alias("r_ts"))
    d = reads.select(F.col("id").alias("read_id"), F.col("key").alias("d_key"), F.col("ts").alias("d_ts"))
    return r.join(d, F.expr(f"r_key = d_key AND d_ts >= r_ts AND d_ts <= r_ts + interval {within}")).select("retrieved_id", "read_id")


def read_feedback_by_time(retrieved: DataFrame, reads: DataFrame, within: str = "5 minutes") -> DataFrame:
    """read_feedback() of tables: keys meet by buckets of time as long as `within`, a retrieval in its own bucket and the next. So a
    file that is read all day is as many groups as the day has buckets, each with what happened in two of them."""
    bucket = lambda c: F.window(F.col(c).cast("timestamp"), within)["start"]
    r = retrieved.where("ts is not null").select(F.col("id").alias("retrieved_id"), F.col("key").alias("_key"), F.col("ts").alias("r_ts"))
    b = r.select("*", bucket("r_ts").alias("_b"))
    r = b.withColumn("_b", F.explode(F.array(F.col("_b"), F.expr(f"_b + interval {within}"))))
    d = reads.where("ts is not null").select(F.col("id").alias("read_id"), F.col("key").alias("_key"), F.col("ts").alias("d_ts"))
    d = d.select("*", bucket("d_ts").alias("_b"))
    return r.join(d, ["_key", "_b"]).where(F.expr(f"d_ts >= r_ts AND d_ts <= r_ts + interval {within}")).select("retrieved_id", "read_id")
