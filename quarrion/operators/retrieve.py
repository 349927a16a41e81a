"""Prompts to ranked chunks: the candidate strategies and the pipeline over them, for any number of prompts at once.

chunks: id, view_id, source_file, layer, section_title, content, summary, keywords (array), hash, importance, token_count,
symbol_name, symbol_kind, parent_symbol, file_stem, line, updated_at. prompts: prompt_id, prompt. Every strategy returns
(prompt_id, strategy, weight, id, score). Names meet prompts by equi-joins: on the lower-cased name, or on the rarest trigram of what
is asked for; never by a nested loop over all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion import config
from quarrion.config import Config
from quarrion.functions import text as T
from quarrion.operators import fulltext, fuse, graph, names, rank, scan, search
from quarrion.operators.common import fresh_folder, settled, small, stored, top
from quarrion.sources.store import Store

# Words too common for a list of their own, expansions by intent, and scores.
PLAIN_TERMS = "function method string number object return const import export class boolean array".split()
PLAIN_TITLES = "file structure data type name code system component".split()
PLAIN_SYMBOLS = "command config store event index file test data type name".split()
BY_INTENT = {"fix": ("error", "bug", "exception", "fix"), "implement": ("api", "interface", "spec", "implement"), "pr": ("pr", "rules", "guidelines")}
ID_SYMBOL, ID_CHILD, ID_TEXT, ID_FILE, ID_SIBLING = 20.0, 15.0, 18.0, 45.0, 14.0
CONCEPT_SYMBOL, CONCEPT_CHILD, CONCEPT_FUZZY = 20.0, 16.0, 8.0


def intents(prompts: DataFrame) -> DataFrame:
    p, t = F.col("prompt"), F.col("_t")
    d = prompts.withColumn("_t", T.tokenize(p))
    return d.select("prompt_id", "prompt", T.concepts(t).alias("concepts"), T.identifiers(p).alias("identifiers"), T.quoted(p).alias("quoted"), T.intent(p).alias("intent"))


def _list(hits: DataFrame, strategy: str | Column, weight: float) -> DataFrame:
    name = F.lit(strategy) if isinstance(strategy, str) else strategy
    return hits.select("prompt_id", name.alias("strategy"), F.lit(weight).alias("weight"), "id", F.col("score").cast("double").alias("score"))


def _terms(i: DataFrame, column: str, out: str = "term") -> DataFrame:
    return i.select("prompt_id", F.explode(column).alias(out)).distinct()


def _unigrams(i: DataFrame) -> DataFrame:
    return _terms(i, "concepts").where(~F.contains("term", F.lit(" ")))


def _kept(pairs: DataFrame) -> DataFrame:
    """What was found of names, to meet the chunks: computed once, and sent to the tasks if it's small."""
    return small(stored(pairs))


def by_symbol(chunks: DataFrame, asked: DataFrame, limit: int = 20, index: names.Names | None = None) -> DataFrame:
    """(prompt_id, name, and the chunk) where the symbol equals or begins with asked(prompt_id, name): exact first, then by id.
    index: of the lower-cased symbols, if one is stored."""
    n = asked.select("prompt_id", "name", F.lower("name").alias("_t")).where(F.length("_t") >= 2)
    s = chunks.where("symbol_name is not null").withColumn("_s", F.lower("symbol_name"))
    pairs = (index or names.index(s.select(F.col("_s").alias("name")))).probed(n.select(F.col("_t").alias("term")).distinct(), prefix=True)
    hits = s.join(_kept(pairs.select(F.col("name").alias("_s"), F.col("term").alias("_t"), (F.col("name") == F.col("term")).alias("_x"))), "_s")
    return top(hits, ["_t"], [F.desc("_x"), "id"], limit).drop("_s", "_x").join(small(n), "_t").drop("_t")


def by_symbol_part(chunks: DataFrame, asked: DataFrame, limit: int = 15, index: names.Names | None = None) -> DataFrame:
    """Where the symbol contains a name of five characters or more."""
    n = asked.select("prompt_id", "name", F.lower("name").alias("_t")).where(F.length("_t") >= 5).distinct()
    s = chunks.where("symbol_name is not null").withColumn("_s", F.lower("symbol_name"))
    pairs = (index or names.index(s.select(F.col("_s").alias("name")))).probed(n.select(F.col("_t").alias("term")).distinct())
    hits = s.join(_kept(pairs.select(F.col("name").alias("_s"), F.col("term").alias("_t"))), "_s").drop("_s")
    return top(hits, ["_t"], ["id"], limit).join(small(n), "_t").drop("_t")


def by_parent(chunks: DataFrame, names: DataFrame, limit: int = 30) -> DataFrame:
    n = names.select("prompt_id", "name", F.lower("name").alias("_n"))
    hits = chunks.where("parent_symbol is not null").withColumn("_n", F.lower("parent_symbol")).join(small(n.select("_n").distinct()), "_n")
    return top(hits, ["_n"], ["id"], limit).join(small(n), "_n").drop("_n")


def by_title(chunks: DataFrame, terms: DataFrame, limit: int = 5, index: names.Names | None = None) -> DataFrame:
    """Where the title contains a term of three characters or more."""
    s = chunks.where("section_title is not null").withColumn("_s", F.lower("section_title"))
    t = terms.select("prompt_id", "term").where(F.length("term") >= 3).distinct()
    pairs = (index or names.index(s.select(F.col("_s").alias("name")))).probed(t.select("term").distinct())
    hits = s.join(_kept(pairs.select("term", F.col("name").alias("_s"))), "_s").drop("_s")
    return top(hits, ["term"], ["id"], limit).join(small(t), "term")


def stem_rank(stem: Column, v: Column, path: Column) -> Column:
    """3 exact, 2 prefix, 1 inside the stem or a folder, else 0."""
    return F.when(stem == v, 3).when(F.startswith(stem, v), 2).when(F.contains(stem, v) | F.contains(path, v), 1).otherwise(0)


def kind_rank(kind: Column, path: Column) -> Column:
    return F.when(path.rlike(r"\.(test|spec)\."), 0).when(kind.isin("function", "method", "class", "struct"), 2).otherwise(1)


def stem_and_path(chunks: DataFrame) -> DataFrame:
    """(name, _f, _p) of the chunks' files: what stems are looked for in, and its two parts."""
    return chunks.select(F.lower("file_stem").alias("_f"), F.lower("source_file").alias("_p")).distinct().select(F.concat_ws(" ", "_f", "_p").alias("name"), "_f", "_p")


def by_stem(chunks: DataFrame, stems: DataFrame, limit: int = 20, index: names.Names | None = None) -> DataFrame:
    """(prompt_id, v, stem_rank, and the chunk) for stems(prompt_id, v): by rank of the match, of the kind, and id.
    index: of the names of stem_and_path(), if one is stored."""
    files = stem_and_path(chunks)
    v = stems.select("prompt_id", F.lower("v").alias("term")).where(F.length("term") >= 3).distinct()
    pairs = files.join(_kept((index or names.index(files)).probed(v.select("term").distinct())), "name")
    pairs = pairs.withColumnRenamed("term", "v").withColumn("stem_rank", stem_rank(F.col("_f"), F.col("v"), F.col("_p"))).where("stem_rank > 0").select("v", "_p", "stem_rank").groupBy("v", "_p").agg(F.max("stem_rank").alias("stem_rank"))
    hits = chunks.withColumn("_p", F.lower("source_file")).join(_kept(pairs), "_p").withColumn("_k", kind_rank(F.col("symbol_kind"), F.col("_p")))
    return top(hits, ["v"], [F.desc("stem_rank"), F.desc("_k"), "id"], limit).drop("_p", "_k").join(small(v.withColumnRenamed("term", "v")), "v")


def class_children(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(prompt_id, id) of the members of the classes among symbol hits, for the longest three names of each name asked for."""
    classes = hits.where(F.col("symbol_kind").isin("class", "struct")).select("prompt_id", "name", "symbol_name").distinct()
    named = top(classes, ["prompt_id", "name"], [F.desc(F.length("symbol_name")), "symbol_name"], config.CLASS_CHILDREN)
    return by_parent(chunks, named.select("prompt_id", F.col("symbol_name").alias("name")).distinct()).select("prompt_id", "id")


@dataclass
class Indexes:
    """What is stored of the chunks: full text, and names by trigrams."""

    text: fulltext.Index
    symbols: names.Names
    titles: names.Names
    files: names.Names


def indexes(chunks: DataFrame, folder: str) -> Indexes:
    """All indexes of the chunks, written under folder."""
    low = lambda c: chunks.select(F.lower(c).alias("name"))
    text = fulltext.create(Store(chunks.sparkSession, f"{folder}/text"), chunks)
    return Indexes(text, names.index(low("symbol_name"), f"{folder}/symbols"), names.index(low("section_title"), f"{folder}/titles"), names.index(stem_and_path(chunks), f"{folder}/files"))


#: Columns of the chunks that lists other than those of words need.
NAMED = ("id", "source_file", "section_title", "keywords", "symbol_name", "symbol_kind", "parent_symbol", "file_stem")


def _scored(chunks: DataFrame, asked: DataFrame, index: Indexes | None, long_words: dict[str, tuple[str, int]] | None) -> Callable[..., DataFrame]:
    """Term sets (prompt_id, term) of the stems asked(term) to (prompt_id, id, score, n_terms): their k best hits at least, and with `whole` those with all
    their stems; scores of nine digits, so that the order of a sum decides no tie. By a pass over the texts, or by the index, if there is one or the stems are
    too many to send to each task."""
    texts = chunks.drop(*(c for c in long_words or {} if c in chunks.columns))
    counts = scan.counted(texts, asked, long_words=long_words) if index is None else None
    if counts:
        return lambda terms, k, whole=False: counts.leaders(terms, k, ("any", "all") if whole else ("any",)).withColumn("score", F.round("score", 9))
    text = index.text if index else fulltext.create(Store(chunks.sparkSession, f"{fresh_folder(chunks.sparkSession, 'indexes')}/text"), chunks)
    parts = settled(fulltext.parts(text, asked))
    return lambda terms, k, whole=False: search.summed(parts, terms).withColumn("score", F.round("score", 9))


def candidate_lists(chunks: DataFrame, i: DataFrame, cfg: Config | None = None, index: Indexes | None = None, named: DataFrame | None = None, long_words: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """All strategies' lists for intents i, each cut to its limit. index: of the chunks, if they are stored; without it, words are found by passes over the texts.
    named: the chunks' NAMED columns, if they are stored. long_words: as for scan.leaders(), for columns that are made of others."""
    cfg = cfg or Config()
    chunks = chunks.withColumn("summary", F.coalesce("summary", F.lit("")))
    c = stored(chunks.select(*NAMED)) if named is None else named
    low = lambda x: c.select(F.lower(x).alias("name"))
    symbols, title_names, file_names = (index.symbols, index.titles, index.files) if index else map(names.passing, (low("symbol_name"), low("section_title"), stem_and_path(c)))
    lists = []
    terms = _unigrams(i)
    words = _terms(i.select("prompt_id", F.slice("concepts", 1, 15).alias("concepts")), "concepts").select("prompt_id", F.explode(T.words(F.col("term"))).alias("term")).distinct()
    ids = _terms(i, "identifiers", "name")
    idw = ids.select("prompt_id", F.explode(T.words(F.col("name"))).alias("term")).distinct()
    extra = i.select("prompt_id", F.explode(F.coalesce(F.element_at(F.create_map(*(x for k, v in BY_INTENT.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("intent")), F.array().cast("array<string>"))).alias("term"))

    def best(hits: DataFrame, n: int) -> DataFrame:
        return top(hits, ["prompt_id"], [F.desc("score"), "id"], n)

    long_ = terms.where((F.length("term") >= 6) & ~F.col("term").isin(*PLAIN_TERMS))
    none = F.lit(None).cast("string").alias("word")
    sets = words.select(F.lit("or").alias("set"), "prompt_id", none, "term").unionByName(idw.select(F.lit("id").alias("set"), "prompt_id", none, "term")).unionByName(extra.select(F.lit("intent").alias("set"), "prompt_id", none, "term"))
    nobody = F.lit(None).cast(i.schema["prompt_id"].dataType).alias("prompt_id")
    sets = sets.unionByName(long_.select("term").distinct().select(F.lit("one").alias("set"), nobody, F.col("term").alias("word"), "term"))
    sets = stored(search.folded(sets, "set", "prompt_id", "word").where("term is not null"))
    words, idw, extra = (sets.where(F.col("set") == x).select("prompt_id", "term") for x in ("or", "id", "intent"))
    scored = _scored(chunks, sets.select("term").distinct(), index, long_words)
    any_ = stored(scored(words, cfg.fts_limit, whole=True))
    n_terms = words.groupBy("prompt_id").agg(F.count("*").alias("n"))
    lists.append(_list(best(any_, cfg.fts_limit), "fts-or", 2.0))
    few = n_terms.where("n between 2 and 6")
    lists.append(_list(best(any_.join(few, "prompt_id").where("n_terms = n"), cfg.fts_limit), "fts-and", 2.0))
    # A term's list is the same for all prompts that have it.
    one = best(scored(sets.where("set = 'one'").select(F.col("word").alias("prompt_id"), "term"), min(cfg.fts_limit, 8)), min(cfg.fts_limit, 8)).select(F.col("prompt_id").alias("term"), "id", "score")
    lists.append(_list(one.join(small(long_), "term").select("prompt_id", "id", "score", F.concat(F.lit("fts-term:"), "term").alias("s")), F.col("s"), 0.4))
    lists.append(_list(best(scored(extra, min(cfg.fts_limit, 8)), min(cfg.fts_limit, 8)), "intent-aware", 1.0))
    phrases = i.select("prompt_id", F.explode("quoted").alias("q")).select(F.concat_ws("\t", F.col("prompt_id").cast("string"), "q").alias("prompt_id"), T.words(F.col("q")).alias("words")).where(F.size("words") > 0)
    quoted = _phrases(chunks, phrases, index).select(F.get(F.split("prompt_id", "\t"), F.lit(0)).cast("long").alias("prompt_id"), "id", F.lit(1.0).alias("score"))
    lists.append(_list(best(quoted.groupBy("prompt_id", "id").agg(F.sum("score").alias("score")), cfg.fts_limit), "quoted-term", 1.0))

    symbol = stored(by_symbol(c, ids, index=symbols).select("prompt_id", "name", "id", "source_file", "symbol_name", "symbol_kind"))
    id_text = stored(c.select("id", "symbol_kind").join(_kept(best(scored(idw, cfg.fts_limit), cfg.fts_limit)), "id"))
    exact = symbol.where(F.lower("symbol_name") == F.lower("name")).select("prompt_id", "source_file", F.col("id").alias("_own")).distinct()
    siblings = top(c.select("id", "source_file").join(_kept(exact), "source_file").where("id <> _own"), ["prompt_id", "_own"], ["id"], 8)
    strong = symbol.select("prompt_id", "id", F.lit(ID_SYMBOL).alias("score")).unionByName(class_children(c, symbol).withColumn("score", F.lit(ID_CHILD)))
    strong = strong.unionByName(id_text.select("prompt_id", "id", F.when(F.col("symbol_kind") == "file", ID_FILE).otherwise(ID_TEXT).alias("score"))).unionByName(siblings.select("prompt_id", "id", F.lit(ID_SIBLING).alias("score")))
    lists.append(_list(strong, "identifier-symbol", 2.0))
    keyed = c.select("id", F.explode("keywords").alias("_n")).withColumn("_n", F.lower("_n")).join(small(ids.select("prompt_id", F.lower("name").alias("_n"))), "_n")
    weak = keyed.select("prompt_id", "id", F.lit(1.0).alias("score")).unionByName(by_parent(c, ids).select("prompt_id", "id", F.lit(1.0).alias("score"))).unionByName(id_text.select("prompt_id", "id", "score"))
    lists.append(_list(weak, "identifier-keyword", 1.0))

    titles = by_title(c, terms.where(~F.col("term").isin(*PLAIN_TITLES)), index=title_names)
    lists.append(_list(titles.select("prompt_id", "id", F.lit(1.0).alias("score")), "section-title", 0.5))

    shaped = i.select("prompt_id", F.concat(F.filter("concepts", lambda x: ~F.contains(x, F.lit(" ")) & (F.length(x) >= 3)), "identifiers").alias("s"), F.transform("identifiers", lambda x: F.lower(x)).alias("low"))
    stems = shaped.select("prompt_id", "low", F.explode("s").alias("s")).select("prompt_id", "low", F.explode(T.stem_variants(F.col("s"))).alias("v"))
    stems = stems.select("prompt_id", F.lower("v").alias("v"), ((F.length("v") < 5) & ~F.exists("low", lambda x: F.contains(x, F.lower("v")))).alias("weak")).distinct()
    files = stored(by_stem(c, stems.select("prompt_id", "v"), index=file_names).select("prompt_id", "v", "id", "source_file", "file_stem").join(small(stems), ["prompt_id", "v"]))
    same = F.translate(F.lower("file_stem"), "-", "") == F.translate("v", "-", "")
    n = F.length("v")
    lists.append(_list(files.where(same).select("prompt_id", "id", F.when(F.col("weak"), 8.0).otherwise(30.0 + F.least(n, F.lit(12))).alias("score")), "file-stem-exact", 2.0))
    inside = F.contains(F.lower("file_stem"), F.col("v"))
    lists.append(_list(files.where(~same & (inside | ~F.col("weak"))).select("prompt_id", "id", F.when(~inside, 3.0).when(F.col("weak"), 2.0).otherwise(10.0 + F.least(n, F.lit(8))).alias("score")), "file-stem", 1.0))
    found = files.select("prompt_id", "source_file").distinct()
    leading = top(c.select("id", "source_file").join(_kept(found.select("source_file").distinct()), "source_file"), ["source_file"], ["id"], 8)
    lists.append(_list(leading.join(_kept(found), "source_file").select("prompt_id", "id", F.lit(12.0).alias("score")), "file-sibling", 1.0))

    tokens = i.select("prompt_id", T.match_tokens(F.concat("identifiers", F.filter("concepts", lambda x: ~F.contains(x, F.lit(" "))))).alias("t"))
    tokens = tokens.select("prompt_id", F.explode("t").alias("name")).where(F.length("name") >= 4).distinct()
    sym = stored(by_symbol(c, tokens, index=symbols).select("prompt_id", "name", "id", "symbol_name", "symbol_kind"))
    lists.append(_list(sym.select("prompt_id", "id", F.lit(CONCEPT_SYMBOL).alias("score")).unionByName(class_children(c, sym).withColumn("score", F.lit(CONCEPT_CHILD))), "concept-symbol-exact", 2.0))
    fuzzy = by_symbol_part(c, tokens.where((F.length("name") >= 7) & ~F.col("name").isin(*PLAIN_SYMBOLS)), index=symbols)
    lists.append(_list(fuzzy.select("prompt_id", "id", F.lit(CONCEPT_FUZZY).alias("score")), "concept-symbol-fuzzy", 1.0))
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def _phrases(chunks: DataFrame, asked: DataFrame, index: Indexes | None) -> DataFrame:
    """(prompt_id, id) of the chunks with the words of asked(prompt_id, words) one after another in the content, the title or the summary."""
    columns = ("content", "section_title", "summary")
    found = scan.phrases(chunks.where("view_id is not null"), asked, columns) if index is None else None
    if found is None:
        text = index.text if index else fulltext.create(Store(chunks.sparkSession, f"{fresh_folder(chunks.sparkSession, 'indexes')}/text"), chunks)
        found = fulltext.phrases(text, asked.select("*", F.explode(F.array(*map(F.lit, columns))).alias("col")))
    return found


def retrieved(chunks: DataFrame, edges: DataFrame, prompts: DataFrame, feedback: DataFrame | None = None, cfg: Config | None = None, as_of_ms: Column | None = None, index: Indexes | None = None, long_words: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """prompts to at most cfg.max_results chunks each, with score, rank and why: fuse, expand by graph, merge, re-score, diversify,
    drop what is contained or repeated, cap segments, cut. index and long_words: as for candidate_lists(). Texts of chunks join after the cut."""
    cfg = cfg or Config()
    i = settled(intents(prompts))
    c = stored(chunks.select(*NAMED))
    direct = stored(fuse.rrf(candidate_lists(chunks, i, cfg, index, c, long_words), trace=True))
    best = c.select("id", "keywords", "symbol_name").join(_kept(top(direct.select("prompt_id", "id", "score"), ["prompt_id"], [F.desc("score"), "id"], 5)), "id")
    shaped = best.select("prompt_id", F.explode(F.concat(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), T.is_identifier), F.array(F.coalesce("symbol_name", F.lit(""))))).alias("node")).where(F.length("node") > 2)
    seeds = stored(_terms(i.select("prompt_id", F.concat("identifiers", "quoted").alias("x")), "x", "node").unionByName(shaped).distinct())
    merged = direct.select("prompt_id", "id", "score")
    if cfg.graph_expansion and cfg.graph_depth:
        near = stored(graph.expanded_near(edges, seeds, cfg.graph_depth, cfg.graph_max_nodes))
        ent = c.select("id", F.explode(F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.array(F.coalesce("symbol_name", F.lit("")))))).alias("node"))
        hits = stored(ent.join(small(near), "node").groupBy("prompt_id", "id").agg(F.count("*").alias("n"), F.sum(F.col("score") * 5.0).alias("graph_boost")))
        merged = fuse.merge_expanded(direct, fuse.scored_entities(hits))
        boosts = hits.select("prompt_id", "id", "graph_boost")
    else:
        boosts = direct.limit(0).select("prompt_id", "id", F.col("score").alias("graph_boost"))
    merged = stored(merged)
    held = stored(chunks.join(small(merged.select("id").distinct()), "id", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    texts = [x for x in ("content", "summary", "keywords") if x in held.columns]
    h = merged.join(held.drop(*texts), "id").join(boosts, ["prompt_id", "id"], "left")
    if feedback is not None:
        h = h.join(feedback.select(F.col("key").alias("id"), F.col("adjustment").alias("feedback")), "id", "left")
    else:
        h = h.withColumn("feedback", F.lit(0.0))
    asked = i.select("prompt_id", F.transform("identifiers", lambda x: F.lower(x)).alias("ids"), T.match_tokens(F.concat("identifiers", F.filter("concepts", lambda x: ~F.contains(x, F.lit(" "))))).alias("terms"))
    h = settled(rank.rescored(h.join(small(asked), "prompt_id"), cfg, as_of_ms))
    h = h.withColumn("exact", F.coalesce(F.array_contains("ids", F.lower("symbol_name")), F.lit(False)))
    if cfg.diversity_filter:
        h = settled(rank.diversified(h, cfg))
    if cfg.containment_dedup:
        h = settled(rank.containment(h))
    h = rank.segment_cap(settled(rank.hash_deduplicated(h)))
    h = top(h, ["prompt_id"], [F.desc("score"), "id"], cfg.max_results, "rank").join(held.select("_row", *texts), "_row").drop("_row")
    return h.join(direct.select("prompt_id", "id", "contributions"), ["prompt_id", "id"], "left")


#: How much more a hit of the active view counts, where there are several.
LOCALITY = 1.1


@dataclass
class View:
    """A view to be searched: its chunks and edges are made when it's their turn, so that what is broken there fails there."""

    view_id: str
    chunks: Callable[[], DataFrame]
    edges: Callable[[], DataFrame]
    index: Indexes | None = None


def over_views(views: list[View], prompts: DataFrame, active: DataFrame, shared: View | None = None, cfg: Config | None = None, layers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, status) of retrieved() over several views and the shared store, if there is one.

    Each view is a plan of its own over its own statistics; fused scores are what compares. A view that fails has a row in status (view_id, ok, n,
    error) and no hits; if all fail, so does the search. active(prompt_id, active_view): where there are several views, hits of a prompt's active view
    count LOCALITY times. The shared store gives its layer `global` only, and is left out if that isn't among `layers`. hits have the view's id and
    ref, an id that is unique over views; cfg.max_results a prompt, ties by view and id.
    """
    cfg = cfg or Config()
    asked = [(v, None) for v in views] + ([(shared, "global")] if shared and (not layers or "global" in layers) else [])

    def one(view: View, layer: str | None) -> tuple[DataFrame | None, str | None]:
        try:
            chunks = view.chunks()
            if layer:
                chunks = chunks.where(F.col("layer") == layer)
            got = retrieved(chunks, view.edges(), prompts, cfg=cfg, index=view.index)
            if layers:
                got = got.where(F.col("layer").isin(*layers))
            return stored(got.drop("view_id", "rank").withColumn("view_id", F.lit(view.view_id))), None
        except Exception as error:  # whatever is wrong with a view, the others answer
            return None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda x: one(*x), asked))
    if views and not any(df is not None for df, _ in found[: len(views)]):
        raise RuntimeError("all views failed: " + "; ".join(f"{v.view_id}: {e}" for (v, _), (_, e) in zip(asked, found, strict=True) if e))
    spark = prompts.sparkSession
    status = spark.createDataFrame([(v.view_id, e is None, None if df is None else df.count(), e) for (v, _), (df, e) in zip(asked, found, strict=True)], "view_id string, ok boolean, n long, error string")
    hits = None
    for df, _ in found:
        if df is not None:
            hits = df if hits is None else hits.unionByName(df, allowMissingColumns=True)
    near = (F.col("view_id") == F.col("active_view")) & F.lit(len(views) > 1)
    hits = hits.join(small(active.select("prompt_id", "active_view").distinct()), "prompt_id", "left").withColumn("score", F.when(F.coalesce(near, F.lit(False)), F.col("score") * LOCALITY).otherwise(F.col("score")))
    hits = hits.withColumn("ref", T.ref(F.col("view_id"), "chunk", F.col("id"))).drop("active_view")
    return top(hits, ["prompt_id"], [F.desc("score"), "view_id", "id"], cfg.max_results, "rank"), status
