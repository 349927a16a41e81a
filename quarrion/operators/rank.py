"""Re-scoring, diversity, and the removal of what repeats or contains other hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.config import Config
from quarrion.functions import text as T
from quarrion.operators.common import top

# Paths that are never answers, and words too common to match inside a name.
POISON = r"/node_modules/|/\.git/|changelog|changes\.md|history\.md|\.map$|\.lock$|\.min\.js$|\.min\.css$"
#: Verbs with which the main functions of a module begin.
PRIMARY_VERBS = "extract parse compile expand start init register create add search match load merge detect apply stem".split()
WEAK_INSIDE = "source file path name type data index test config value event context layer token budget".split()


def poisoned(path: Column) -> Column:
    return F.lower(path).rlike(POISON)


def compact(x: Column) -> Column:
    return F.regexp_replace(x, "[_-]", "")


def name_multiplier(symbol: Column, kind: Column, tokens: Column, parent: Column, stem: Column, path: Column, ids: Column, terms: Column) -> Column:
    """The best match of a prompt's identifiers and terms (arrays, lower case) with a chunk's names; 1 if there is none."""
    sn, fs, up = (F.lower(F.coalesce(x, F.lit(""))) for x in (symbol, stem, parent))
    parts = F.transform(F.split(F.lower(path), r"[/\\]"), lambda p: p)
    has = lambda x: x != ""
    begins = lambda a, b: F.startswith(a, b) | F.startswith(b, a)
    outline = kind.isin("class", "struct") & (F.coalesce(tokens, F.lit(0)) < 80)

    def by_id(t: Column) -> Column:
        named = F.when(has(sn) & (sn == t), F.when(outline, 2.5).otherwise(3.5)).when(has(sn) & begins(sn, t), 3.0).when(has(sn) & (F.length(t) >= 5) & (F.contains(sn, t) | F.contains(t, sn)), 2.2).otherwise(1.0)
        owned = F.when(has(up) & begins(up, t), 2.8).otherwise(1.0)
        filed = F.when(has(fs) & (F.length(compact(t)) >= 5) & F.contains(compact(fs), compact(t)), 3.5).otherwise(1.0)
        return F.greatest(named, owned, filed)

    def by_term(t: Column) -> Column:
        short = (F.length(t) < 6) & ~F.array_contains(ids, t)
        named = F.when(short | ~has(sn), 1.0).when(sn == t, 3.2).when(begins(sn, t), 2.4).when((F.length(t) >= 5) & (F.contains(sn, t) | F.contains(t, sn)), 1.6).otherwise(1.0)
        ends = F.when(has(sn) & (F.length(t) >= 4) & F.endswith(sn, t), 3.5).otherwise(1.0)
        inside = F.when(has(sn) & (F.length(compact(t)) >= 6) & F.contains(compact(sn), compact(t)) & ~t.isin(*WEAK_INSIDE), 3.2).otherwise(1.0)
        filed = F.when(short, 1.0).when(F.translate(fs, "-", "") == F.translate(t, "-", ""), 3.2).when(begins(fs, t) | ((F.length(t) >= 4) & F.contains(fs, t)), 2.2).otherwise(1.0)
        folder = F.when(~short & F.exists(parts, lambda p: (p == t) | (F.regexp_replace(p, r"\.[^.]+$", "") == t)), 3.0).otherwise(1.0)
        owned = F.when(~short & has(up) & begins(up, t), 2.2).otherwise(1.0)
        return F.greatest(named, ends, inside, filed, folder, owned)

    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(ids, by_id)), F.lit(1.0)), F.coalesce(F.array_max(F.transform(terms, by_term)), F.lit(1.0)))


def foreign(workspace: Column, root: str) -> Column:
    """Whether a workspace's folder is neither the root, inside it, around it, nor named like it."""
    near = (workspace == root) | F.startswith(workspace, F.lit(root + "/")) | F.startswith(F.lit(root), F.concat(workspace, F.lit("/"))) | (F.regexp_extract(workspace, "([^/]*)$", 1) == root.rpartition("/")[2])
    return F.coalesce((F.length(workspace) > 0) & ~near, F.lit(False))


def primary_symbol(symbol: Column, ids: Column, terms: Column) -> Column:
    """Whether a symbol begins with a verb of PRIMARY_VERBS and overlaps what the prompt names (ids and terms, lower case)."""
    s = F.lower(F.coalesce(symbol, F.lit("")))
    by_id = F.exists(ids, lambda t: (s == t) | F.startswith(s, t) | F.startswith(t, s) | ((F.length(t) >= 5) & F.contains(s, t)))
    by_term = F.exists(terms, lambda t: (F.length(t) >= 5) & F.contains(s, t))
    return F.coalesce(s.rlike(f"^({'|'.join(PRIMARY_VERBS)})") & (by_id | by_term), F.lit(False))


def rescored(hits: DataFrame, cfg: Config | None = None, as_of_ms: Column | None = None, root: str | None = None) -> DataFrame:
    """hits with score re-computed: what is added comes before what multiplies, in this order.

    root: the folder that prompts are asked from; hits of the workspace layer from elsewhere (column workspace) then count 0.3.
    Needs score, graph_boost, importance, feedback, ids, terms, layer, updated_at, source_file, section_title, symbol_name,
    symbol_kind, parent_symbol, file_stem, token_count. Poisoned paths are dropped before anything is computed.
    """
    cfg = cfg or Config()
    h = hits.where(~poisoned(F.col("source_file")))
    s = F.col("score") + F.least(F.coalesce("graph_boost", F.lit(0.0)), F.lit(cfg.max_graph_boost))
    s = s + F.least(F.coalesce("importance", F.lit(0)), F.lit(10)) / 10 * 2.0 + F.coalesce("feedback", F.lit(0.0))
    s = s * name_multiplier(*(F.col(c) for c in ("symbol_name", "symbol_kind", "token_count", "parent_symbol", "file_stem", "source_file", "ids", "terms")))
    boost = F.create_map(*(F.lit(x) for pair in cfg.layer_boosts.items() for x in pair))
    s = s * F.coalesce(F.element_at(boost, F.col("layer")), F.lit(1.0))
    if as_of_ms is not None:
        s = s * F.coalesce(T.recency(F.col("updated_at"), as_of_ms), F.lit(1.0))
    n = F.coalesce("token_count", F.lit(0))
    exact = F.coalesce(F.array_contains("ids", F.lower("symbol_name")), F.lit(False))
    kind, low = F.coalesce("symbol_kind", F.lit("")), F.lower("source_file")
    far = (F.col("layer") == "workspace") & foreign(F.col("workspace"), root) if root else F.lit(False)
    factors = (
        (far, 0.3),
        (F.coalesce("section_title", F.lit("")) == "File Structure", 0.45),
        (low.rlike(r"\.(test|spec)\.|/tests?/"), 0.55),
        (low.rlike(r"readme\.md$"), 0.4),
        ((kind == "variable") & (n > 200), 1.8),
        (F.col("parent_symbol").isNotNull() & kind.isin("function", "method"), 1.2),
        (F.col("parent_symbol").isNotNull() & (kind == "segment"), 1.05),
        (kind.isin("class", "struct") & (n < 80) & ~exact, 0.55),
        ((n > 1800) & ~exact, 0.5),
        ((n > 1100) & (n <= 1800) & ~exact, 0.75),
        (file_named(F.col("file_stem"), F.col("ids"), F.col("terms")), 2.5),
        (F.coalesce("symbol_name", F.lit("")) == "constructor", 0.35),
        (F.coalesce(F.col("symbol_name").rlike("^get[A-Z]"), F.lit(False)) & (n < 40), 0.5),
        (primary_symbol(F.col("symbol_name"), F.col("ids"), F.col("terms")), 1.3),
    )
    for condition, factor in factors:
        s = s * F.when(condition, F.lit(factor)).otherwise(F.lit(1.0))
    return h.withColumn("score", s)


def file_named(stem: Column, ids: Column, terms: Column) -> Column:
    """Whether a file is named in the prompt; plain terms need to be longer than identifiers."""
    fs = compact(F.lower(F.coalesce(stem, F.lit(""))))

    def found(least: int):
        return lambda t: (F.length(compact(t)) >= least) & ((fs == compact(t)) | (F.contains(fs, compact(t)) & (F.length(compact(t)) >= least + 2)))

    return F.exists(ids, found(5)) | F.exists(terms, found(8))


def diversified(hits: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Scores of a file's later hits decay, in order of score; exact identifier hits (column exact) don't."""
    cfg = cfg or Config()
    seen = F.row_number().over(Window.partitionBy("prompt_id", "source_file").orderBy(F.desc("score"), "id")) - 1
    start = F.when(F.col("parent_symbol").isNotNull(), max(cfg.diversity_start + 4, 8)).when(F.col("symbol_kind").isin("class", "struct"), cfg.diversity_start + 2).otherwise(cfg.diversity_start)
    over = F.col("_seen") - F.col("_start") + 1
    h = hits.withColumn("_seen", seen).withColumn("_start", start)
    decayed = F.when(~F.col("exact") & (over > 0), F.col("score") * F.pow(F.lit(cfg.diversity_decay), over.cast("double"))).otherwise(F.col("score"))
    return h.withColumn("score", decayed).drop("_seen", "_start")


def hash_deduplicated(hits: DataFrame) -> DataFrame:
    """The best hit of each content hash; hits without a hash stay."""
    key = F.when(F.coalesce("hash", F.lit("")) == "", F.col("id")).otherwise(F.concat(F.lit("h:"), F.col("hash")))
    return top(hits.withColumn("_k", key), ["prompt_id", "_k"], [F.desc("score"), "id"], 1).drop("_k")


def containment(hits: DataFrame, min_tokens: int = 80, giant: int = 500, keep: int = 1200) -> DataFrame:
    """Classes against their methods, then functions against their segments, each pair within a file.

    Needs prompt_id, id, source_file, symbol_name, symbol_kind, parent_symbol, token_count, score, exact. A class under
    min_tokens stays beside its methods; a giant one, or one that a method beats, gives 0.15 of its score
    to them and goes; else they go and give it 0.25 of theirs. A function that is exact or at most `keep` tokens
    replaces its segments (and inherits 0.95 of the best if not exact); a larger one goes, and they inherit 0.9 of its score.
    """
    key = ["prompt_id", "source_file"]
    classes = hits.where(F.col("symbol_kind").isin("class", "struct")).select(*key, F.col("symbol_name").alias("parent_symbol"), F.col("id").alias("p_id"), F.col("score").alias("p_score"), F.col("token_count").alias("p_tokens"))
    kids = hits.where((F.col("symbol_kind") != "segment") & F.col("parent_symbol").isNotNull()).join(classes, [*key, "parent_symbol"])
    per = kids.groupBy("prompt_id", "p_id", "p_score", "p_tokens").agg(F.max("score").alias("best"), F.sum("score").alias("sum"), F.count("*").alias("n"))
    per = per.withColumn("fate", F.when(F.col("p_tokens") < min_tokens, "both").when((F.col("p_tokens") > giant) | (F.col("best") >= F.col("p_score")), "kids").otherwise("class"))
    to_kids = kids.select("prompt_id", "id", "p_id").join(per.select("prompt_id", "p_id", "fate", "n", "p_score"), ["prompt_id", "p_id"])
    kid = to_kids.groupBy("prompt_id", "id").agg(F.max(F.col("fate") == "class").alias("drop_kid"), F.sum(F.when(F.col("fate") == "kids", 0.15 * F.col("p_score") / F.col("n")).otherwise(0.0)).alias("gain"))
    h = hits.join(kid, ["prompt_id", "id"], "left").join(per.select("prompt_id", F.col("p_id").alias("id"), "fate", (0.25 * F.col("sum")).alias("share")), ["prompt_id", "id"], "left")
    h = h.where(~F.coalesce("drop_kid", F.lit(False)) & F.coalesce(F.col("fate") != "kids", F.lit(True)))
    h = h.withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)) + F.when(F.col("fate") == "class", F.col("share")).otherwise(0.0)).select(*hits.columns)
    whole = h.where(F.col("symbol_kind").isin("function", "method")).select(*key, F.col("symbol_name").alias("parent_symbol"), F.col("id").alias("p_id"), F.col("score").alias("p_score"), (F.col("exact") | (F.col("token_count") <= keep)).alias("stays"))
    parts = h.where("symbol_kind = 'segment'").join(whole, [*key, "parent_symbol"])
    best = parts.groupBy("prompt_id", "p_id", "stays").agg(F.max("score").alias("best"))
    part = parts.groupBy("prompt_id", "id").agg(F.max("stays").alias("drop_part"), F.max(0.9 * F.col("p_score")).alias("floor"))
    h = h.join(part, ["prompt_id", "id"], "left").join(best.withColumnRenamed("p_id", "id"), ["prompt_id", "id"], "left")
    h = h.where(~F.coalesce("drop_part", F.lit(False)) & F.coalesce("stays", F.lit(True)))
    lifted = F.when(F.col("best").isNotNull() & ~F.col("exact"), F.greatest("score", 0.95 * F.col("best"))).when(F.col("floor").isNotNull(), F.greatest("score", "floor")).otherwise(F.col("score"))
    return h.withColumn("score", lifted).select(*hits.columns)


def segment_cap(hits: DataFrame, n: int = 4) -> DataFrame:
    """At most n segments a prompt: those whose parent is among the hits first, then by score."""
    parents = hits.where("symbol_kind <> 'segment'").select("prompt_id", "source_file", F.col("symbol_name").alias("parent_symbol")).distinct().withColumn("_p", F.lit(True))
    s = hits.where("symbol_kind = 'segment'").join(parents, ["prompt_id", "source_file", "parent_symbol"], "left")
    best = top(s, ["prompt_id"], [F.desc(F.coalesce("_p", F.lit(False))), F.desc("score"), "id"], n).select(*hits.columns)
    return hits.where(F.coalesce(F.col("symbol_kind") != "segment", F.lit(True))).unionByName(best)


def signal_symbol(symbol: Column, signals: Column) -> Column:
    """Whether a symbol equals, holds or lies in a signal term (5 letters or more, lower case), or shares a word of 5 letters or more with one."""
    s = F.lower(symbol)
    whole = F.exists(signals, lambda t: (s == t) | ((F.length(t) >= 5) & (F.contains(s, t) | F.contains(t, s))))
    parts = F.filter(F.transform(F.split(symbol, r"(?=[A-Z])|[_\-.]+"), lambda p: F.lower(p)), lambda p: F.length(p) >= 5)
    words = F.flatten(F.transform(signals, lambda t: F.split(t, r"[\s_-]+")))
    return F.coalesce((s != "") & (whole | F.arrays_overlap(parts, words) | F.arrays_overlap(parts, signals)), F.lit(False))


def relative_cut(hits: DataFrame) -> DataFrame:
    """The five best, what reaches max(5, 0.35 of the best), exact hits, tiny ones that reach 0.4 of that, hits whose symbol is a
    signal (columns symbol_name and signals), and, if they have a symbol, those from files of the five best."""
    w = Window.partitionBy("prompt_id")
    r = hits.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("_m", F.greatest(F.lit(5.0), 0.35 * F.max("score").over(w)))
    r = r.withColumn("_f", F.max(F.col("_r") <= 5).over(Window.partitionBy("prompt_id", "source_file")))
    tiny = (F.coalesce("token_count", F.lit(0)) < 60) & (F.col("score") >= 0.4 * F.col("_m"))
    named = F.coalesce("symbol_name", F.lit("")) != ""
    return r.where((F.col("_r") <= 5) | (F.col("score") >= F.col("_m")) | F.col("exact") | tiny | signal_symbol(F.col("symbol_name"), F.col("signals")) | (named & F.col("_f"))).drop("_r", "_m", "_f")
