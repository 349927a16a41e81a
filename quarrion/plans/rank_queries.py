"""Queries of fusion, scoring, deduplication and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.config import Config
from quarrion.operators import fuse, rank, windows
from quarrion.operators.common import r6, small, stored, top
from quarrion.plans import corpus
from quarrion.plans.corpus import sql
from quarrion.plans.registry import query, table
from quarrion.plans.search_queries import BASE, BM25, hits

LISTS = BM25 + """,
lists AS (
  SELECT prompt_id, 'any' AS strategy, CAST(2.0 AS DOUBLE) AS weight, id, round(score, 9) AS score FROM bm
  UNION ALL SELECT prompt_id, 'several', 1.0, id, round(score * n_terms, 9) FROM bm WHERE n_terms >= 2
  UNION ALL SELECT prompt_id, 'one', 0.4, id, round(score, 9) FROM bm WHERE n_terms = 1),
cut AS (SELECT * EXCLUDE (k), k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, strategy ORDER BY score DESC, id) AS k FROM lists) WHERE k <= 15),
fused AS (SELECT prompt_id, id, round(sum(weight / (61 + rank) * 100), 9) AS score FROM cut GROUP BY ALL)"""


def lists(spark, sf_dir):
    h = hits(spark, sf_dir, 15)
    parts = (("any", 2.0, F.col("score"), "n_terms >= 1"), ("several", 1.0, F.col("score") * F.col("n_terms"), "n_terms >= 2"), ("one", 0.4, F.col("score"), "n_terms = 1"))
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(w).alias("weight"), F.round(s, 9).alias("score"), F.expr(c).alias("ok")) for n, w, s, c in parts)))
    all_ = h.select("prompt_id", "id", "n_terms", "score").withColumn("k", kinds).where("k.ok").select("prompt_id", "k.strategy", "k.weight", "id", "k.score")
    return stored(top(all_, ["prompt_id", "strategy"], [F.desc("score"), "id"], 15))


def fused(spark, sf_dir):
    return fuse.rrf(lists(spark, sf_dir)).withColumn("score", F.round("score", 9))


def full(spark, sf_dir):
    """Fused hits with their chunks' columns."""
    c = corpus.chunks(spark, sf_dir)
    return c.join(small(stored(fused(spark, sf_dir))), "id").withColumns({"exact": F.col("doc_id") % 7 == 0, "parent_symbol": F.when(F.col("doc_id") % 5 == 0, "p"), "symbol_kind": F.when(F.col("line") == 0, "class").otherwise("function")})


@query("w1_strategy_rank", sql(LISTS + "\nSELECT prompt_id, strategy, id, rank FROM cut", *BASE))
def w1_strategy_rank(spark, sf_dir):
    return fuse.ranked(lists(spark, sf_dir)).select("prompt_id", "strategy", "id", "rank")


@query("a8_rrf", sql(LISTS + "\nSELECT prompt_id, id, round(score, 6) AS score FROM fused", *BASE))
def a8_rrf(spark, sf_dir):
    return fused(spark, sf_dir).select("prompt_id", "id", r6(F.col("score"), "score"))


@query("r17_trace", sql(LISTS + "\nSELECT prompt_id, id, count(*) AS n_lists, string_agg(strategy, ',' ORDER BY strategy) AS strategies FROM cut GROUP BY ALL", *BASE))
def r17_trace(spark, sf_dir):
    t = fuse.rrf(lists(spark, sf_dir), trace=True)
    return t.select("prompt_id", "id", F.size("contributions").cast("long").alias("n_lists"), F.array_join(F.transform("contributions", lambda x: x["strategy"]), ",").alias("strategies"))


@query("r8_confidence", sql(LISTS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS k FROM fused),
s AS (SELECT prompt_id, count(*) AS n, max(CASE WHEN k = 1 THEN score END) AS best, max(CASE WHEN k = 2 THEN score END) AS second FROM r GROUP BY ALL)
SELECT p.prompt_id, coalesce(n, 0) AS n, round(best, 6) AS best, round((best - second) / best, 6) AS margin,
       n IS NULL OR best < 8 OR coalesce((best - second) / best < 0.15, false) AS low
FROM prompts p LEFT JOIN s USING (prompt_id)""", *BASE))
def r8_confidence(spark, sf_dir):
    c = fuse.confidence(fused(spark, sf_dir), corpus.prompts(spark, sf_dir))
    return c.select("prompt_id", "n", r6(F.col("best"), "best"), r6(F.col("margin"), "margin"), "low")


@query("a9_merge_unique", sql(LISTS + "\nSELECT prompt_id, strategy, weight, id, round(2 * score, 6) AS score FROM cut", *BASE))
def a9_merge_unique(spark, sf_dir):
    x = lists(spark, sf_dir)
    return fuse.merge_unique(x.unionByName(x)).withColumn("score", F.round("score", 6))


@query("a10_entity_scores", sql("""
SELECT p.prompt_id, w.id, round(0.5 + 0.15 * (count(*) - 1), 6) AS score FROM prompt_terms p JOIN (SELECT DISTINCT id, term FROM words) w USING (term) WHERE length(term) >= 6 GROUP BY ALL""", *BASE))
def a10_entity_scores(spark, sf_dir):
    from quarrion.operators import search

    t = corpus.prompt_terms(corpus.prompts(spark, sf_dir)).where(F.length("term") >= 6)
    m = search.postings(corpus.chunks(spark, sf_dir), keep=t).select("id", "term").distinct().join(t, "term")
    return fuse.entity_scores(m).withColumn("score", F.round("score", 6))


@query("j5_overlap_merge", sql(LISTS + """,
e AS (SELECT p.prompt_id, w.id, round(0.5 + 0.15 * (count(*) - 1), 9) AS e FROM prompt_terms p JOIN (SELECT DISTINCT id, term FROM words) w USING (term) WHERE length(term) >= 6 GROUP BY ALL)
SELECT prompt_id, id, round(coalesce(score + 1.5 * e, score, e), 6) AS score FROM fused FULL OUTER JOIN e USING (prompt_id, id)""", *BASE))
def j5_overlap_merge(spark, sf_dir):
    return fuse.merge_expanded(fused(spark, sf_dir), a10_entity_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("j6_missing_parents", sql(LISTS + """
SELECT DISTINCT f.prompt_id, h.id FROM fused f JOIN chunks c USING (id) JOIN chunks h ON h.source_file = c.source_file AND h.line = 0
WHERE c.line > 0 AND (f.prompt_id, h.id) NOT IN (SELECT (prompt_id, id) FROM fused)""".replace("(f.prompt_id, h.id) NOT IN (SELECT (prompt_id, id) FROM fused)", "NOT EXISTS (SELECT 1 FROM fused g WHERE g.prompt_id = f.prompt_id AND g.id = h.id)"), *BASE))
def j6_missing_parents(spark, sf_dir):
    return windows.missing_parents(fused(spark, sf_dir), corpus.chunks(spark, sf_dir))


@query("j7_feedback", sql(LISTS + """,
a AS (SELECT doc_id, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END - toxic) AS BIGINT) AS adjustment FROM labels GROUP BY ALL)
SELECT f.prompt_id, f.id, CASE WHEN a.adjustment IS NULL THEN 0 ELSE least(greatest(a.adjustment, -5), 5) END AS adjustment, round(f.score + CASE WHEN a.adjustment IS NULL THEN 0 ELSE least(greatest(a.adjustment, -5), 5) END, 6) AS score
FROM fused f JOIN chunks c USING (id) LEFT JOIN a USING (doc_id)""", *BASE))
def j7_feedback(spark, sf_dir):
    from quarrion.operators import memory

    signals = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.when(F.col("quality") == 1, 1).otherwise(-1) - F.col("toxic")).cast("long").alias("adjustment"))
    h = full(spark, sf_dir).join(memory.adjustments(signals), F.col("doc_id") == F.col("key"), "left")
    return h.select("prompt_id", "id", F.coalesce("adjustment", F.lit(0).cast("long")).alias("adjustment"), r6(F.col("score") + F.coalesce("adjustment", F.lit(0)), "score"))


@query("j11_file_siblings", sql(LISTS + """,
t AS (SELECT prompt_id, id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS k FROM fused) WHERE k <= 3)
SELECT DISTINCT t.prompt_id, s.id FROM t JOIN chunks c USING (id) JOIN chunks s ON s.source_file = c.source_file
WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.prompt_id = t.prompt_id AND u.id = s.id)""", *BASE))
def j11_file_siblings(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    best = top(fused(spark, sf_dir), ["prompt_id"], [F.desc("score"), "id"], 3)
    files = best.join(c, "id").select("prompt_id", "source_file").distinct()
    return files.join(c.select("source_file", "id"), "source_file").join(best, ["prompt_id", "id"], "left_anti").select("prompt_id", "id")


FULL_SQL = LISTS + """,
hit AS (SELECT f.prompt_id, f.id, f.score, c.* EXCLUDE (id), c.doc_id % 7 = 0 AS exact, CASE WHEN c.doc_id % 5 = 0 THEN 'p' END AS parent_symbol,
               CASE WHEN c.line = 0 THEN 'class' ELSE 'function' END AS symbol_kind FROM fused f JOIN chunks c USING (id))"""


@query("w3_diversity", sql(FULL_SQL + """,
x AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, source_file ORDER BY score DESC, id) - 1 AS seen,
      CASE WHEN parent_symbol IS NOT NULL THEN 8 WHEN symbol_kind = 'class' THEN 3 ELSE 1 END AS start FROM hit)
SELECT prompt_id, id, round(CASE WHEN NOT exact AND seen >= start THEN score * pow(0.7, seen - start + 1) ELSE score END, 6) AS score FROM x""", *BASE))
def w3_diversity(spark, sf_dir):
    return rank.diversified(full(spark, sf_dir), Config(diversity_start=1)).select("prompt_id", "id", r6(F.col("score"), "score"))


@query("w4_hash_dedup", sql(FULL_SQL + """
SELECT prompt_id, id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, hash ORDER BY score DESC, id) AS k FROM hit) WHERE k = 1""", *BASE))
def w4_hash_dedup(spark, sf_dir):
    return rank.hash_deduplicated(full(spark, sf_dir)).select("prompt_id", "id")


@query("w5_primaries", sql(FULL_SQL + """,
x AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, source_file ORDER BY score DESC, id) AS k FROM hit),
y AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS r FROM x WHERE k <= 2)
SELECT prompt_id, id, r - 1 AS rank FROM y WHERE r <= 5""", *BASE))
def w5_primaries(spark, sf_dir):
    from quarrion.operators import compiling

    return compiling.primaries(full(spark, sf_dir).withColumn("lead", F.col("score"))).select("prompt_id", "id", "rank")


@query("p11_relative_cut", sql(FULL_SQL + r""",
g AS (SELECT prompt_id, list_filter(list(term), lambda t: length(t) >= 4) AS g FROM prompt_terms GROUP BY ALL),
x AS (SELECT hit.*, g.g, regexp_extract(content, '[A-Za-z]{4,}') AS symbol, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS r, greatest(5, 0.35 * max(score) OVER (PARTITION BY prompt_id)) AS m FROM hit JOIN g USING (prompt_id)),
y AS (SELECT *, bool_or(r <= 5) OVER (PARTITION BY prompt_id, source_file) AS f, lower(symbol) AS s FROM x)
SELECT prompt_id, id FROM y WHERE r <= 5 OR score >= m OR exact OR (token_count < 60 AND score >= 0.4 * m)
  OR s <> '' AND (f OR len(list_filter(g, lambda t: s = t OR length(t) >= 5 AND (contains(s, t) OR contains(t, s)))) > 0)""", *BASE))
def p11_relative_cut(spark, sf_dir):
    g = corpus.prompt_terms(corpus.prompts(spark, sf_dir)).where(F.length("term") >= 4).groupBy("prompt_id").agg(F.collect_list("term").alias("signals"))
    h = full(spark, sf_dir).withColumn("symbol_name", F.regexp_extract("content", "[A-Za-z]{4,}", 0))
    return rank.relative_cut(h.join(g, "prompt_id")).select("prompt_id", "id")


@query("o4_final_top", sql(FULL_SQL + "\nSELECT prompt_id, id, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS k FROM hit) WHERE k <= 25", *BASE))
def o4_final_top(spark, sf_dir):
    return top(full(spark, sf_dir), ["prompt_id"], [F.desc("score"), "id"], Config().max_results, "rank").select("prompt_id", "id", "rank")


@query("r12_scoring", """
WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'load_widget' || p_partkey ELSE replace(p_name, ' ', '_') END AS sn, lower(p_type) AS up, split_part(p_name, ' ', 2) AS fs, ['class', 'function', 'variable', 'segment'][p_size % 4 + 1] AS kind,
  p_size * 40 AS n, ['global','workspace','repo','session'][p_partkey % 4 + 1] AS layer, p_partkey % 12 AS imp, p_partkey % 3 - 1 AS fb, p_partkey % 17 AS gb,
  'src/' || split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 9 = 0 THEN '/tests/' ELSE '/' END || p_partkey || CASE WHEN p_partkey % 23 = 0 THEN '.lock' ELSE '.ts' END AS path, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS parent,
  p_partkey % 40 + 1 AS base FROM part),
b AS (SELECT *, greatest(1.0, list_max(list_transform(['small_ring', 'widget'], lambda t: greatest(
      CASE WHEN sn = t THEN CASE WHEN kind = 'class' AND n < 80 THEN 2.5 ELSE 3.5 END WHEN starts_with(sn, t) OR starts_with(t, sn) THEN 3.0 WHEN length(t) >= 5 AND (contains(sn, t) OR contains(t, sn)) THEN 2.2 ELSE 1.0 END,
      CASE WHEN parent IS NOT NULL AND (starts_with(parent, t) OR starts_with(t, parent)) THEN 2.8 ELSE 1.0 END,
      CASE WHEN length(replace(t, '_', '')) >= 5 AND contains(fs, replace(t, '_', '')) THEN 3.5 ELSE 1.0 END))),
    list_max(list_transform(['economy', 'ring'], lambda t: greatest(
      CASE WHEN length(t) < 6 THEN 1.0 WHEN sn = t THEN 3.2 WHEN starts_with(sn, t) OR starts_with(t, sn) THEN 2.4 WHEN contains(sn, t) OR contains(t, sn) THEN 1.6 ELSE 1.0 END,
      CASE WHEN ends_with(sn, t) THEN 3.5 ELSE 1.0 END, CASE WHEN length(t) >= 6 AND contains(replace(sn, '_', ''), t) THEN 3.2 ELSE 1.0 END,
      CASE WHEN length(t) < 6 THEN 1.0 WHEN fs = t THEN 3.2 WHEN starts_with(fs, t) OR starts_with(t, fs) OR contains(fs, t) THEN 2.2 ELSE 1.0 END,
      CASE WHEN length(t) >= 6 AND fs = t THEN 3.0 ELSE 1.0 END,
      CASE WHEN length(t) >= 6 AND parent IS NOT NULL AND (starts_with(parent, t) OR starts_with(t, parent)) THEN 2.2 ELSE 1.0 END)))) AS best FROM h WHERE NOT ends_with(path, '.lock'))
SELECT p_partkey, round((base + least(gb, 10) + least(imp, 10) / 10.0 * 2.0 + fb) * best * CASE layer WHEN 'session' THEN 1.5 WHEN 'repo' THEN 1.3 WHEN 'workspace' THEN 1.1 ELSE 1.0 END
  * CASE WHEN contains(path, '/tests/') THEN 0.55 ELSE 1 END * CASE WHEN kind = 'variable' AND n > 200 THEN 1.8 ELSE 1 END
  * CASE WHEN parent IS NOT NULL AND kind = 'function' THEN 1.2 ELSE 1 END * CASE WHEN parent IS NOT NULL AND kind = 'segment' THEN 1.05 ELSE 1 END
  * CASE WHEN kind = 'class' AND n < 80 AND sn NOT IN ('small_ring', 'widget') THEN 0.55 ELSE 1 END
  * CASE WHEN sn IN ('small_ring', 'widget') THEN 1 WHEN n > 1800 THEN 0.5 WHEN n > 1100 THEN 0.75 ELSE 1 END
  * CASE WHEN fs IN ('widget', 'smallring') THEN 2.5 ELSE 1 END
  * CASE WHEN layer = 'workspace' AND p_partkey % 3 = 0 THEN 0.3 ELSE 1 END
  * CASE WHEN regexp_matches(sn, '^(extract|parse|compile|expand|start|init|register|create|add|search|match|load|merge|detect|apply|stem)')
         AND (sn IN ('small_ring', 'widget') OR contains(sn, 'widget') OR contains(sn, 'small_ring') OR contains(sn, 'economy')) THEN 1.3 ELSE 1 END, 6) AS score FROM b""")
def r12_scoring(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    fs, key = F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey")
    folder = F.when(key % 9 == 0, "/tests/").otherwise("/")
    h = p.select(
        "p_partkey", F.when(key % 7 == 0, F.concat(F.lit("load_widget"), key.cast("string"))).otherwise(F.translate("p_name", " ", "_")).alias("symbol_name"), F.when(key % 2 == 0, F.lower("p_type")).alias("parent_symbol"), fs.alias("file_stem"), pick(("class", "function", "variable", "segment"), F.col("p_size") % 4).alias("symbol_kind"),
        (F.col("p_size") * 40).alias("token_count"), pick(corpus.LAYERS, key % 4).alias("layer"), (key % 12).alias("importance"), (key % 3 - 1).alias("feedback"), (key % 17).alias("graph_boost"),
        F.concat(F.lit("src/"), fs, folder, key.cast("string"), F.when(key % 23 == 0, ".lock").otherwise(".ts")).alias("source_file"), (key % 40 + 1).alias("score"),
        F.array(F.lit("small_ring"), F.lit("widget")).alias("ids"), F.array(F.lit("economy"), F.lit("ring")).alias("terms"), F.lit(None).cast("string").alias("section_title"),
        pick(("/else/where", "/home/me/app", "/home/me/app/sub"), key % 3).alias("workspace"),
    )
    return rank.rescored(h, root="/home/me/app").select("p_partkey", r6(F.col("score"), "score"))


@query("p9_poison_paths", """
SELECT event_id, regexp_matches(lower(p), '/node_modules/|/\\.git/|changelog|changes\\.md|history\\.md|\\.map$|\\.lock$|\\.min\\.js$|\\.min\\.css$') AS poisoned
FROM (SELECT event_id, 'a/' || event_type || ['/node_modules/x.js', '/b.ts', '/CHANGELOG.md', '/y.min.js', '/z.map', '/history.md'][event_id % 6 + 1] AS p FROM events)""")
def p9_poison_paths(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, ("/node_modules/x.js", "/b.ts", "/CHANGELOG.md", "/y.min.js", "/z.map", "/history.md"))), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", rank.poisoned(F.concat(F.lit("a/"), "event_type", tail)).alias("poisoned"))


KNN = """
WITH q AS (SELECT vec_id AS prompt_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.prompt_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.q, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score FROM q CROSS JOIN embeddings v),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 15)"""


def _near(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return fuse.nearest(v.where("id % 50 = 0").select(F.col("id").alias("prompt_id"), F.col("embedding").alias("q")), v)


@query("o6_knn", KNN + "\nSELECT prompt_id, id, rank, round(score, 6) AS score FROM near")
def o6_knn(spark, sf_dir):
    return _near(spark, sf_dir).select("prompt_id", "id", "rank", r6(F.col("score"), "score"))


@query("j9_containment", """
WITH k AS (SELECT o_custkey AS prompt_id, o_orderkey AS o, n, floor(price / 1000) AS score FROM (SELECT l_orderkey, l_linenumber AS n, max(CAST(l_extendedprice AS DOUBLE)) AS price FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT o, max(score) AS best, sum(score) AS total, count(*) AS n FROM k GROUP BY o),
c AS (SELECT o_custkey AS prompt_id, o_orderkey AS o, floor(CAST(o_totalprice AS DOUBLE) / 4000) AS score, total, s.n, CASE WHEN s.n IS NULL THEN 'alone' WHEN o_orderkey % 700 < 80 THEN 'both' WHEN o_orderkey % 700 > 500 OR best >= floor(CAST(o_totalprice AS DOUBLE) / 4000) THEN 'kids' ELSE 'class' END AS fate FROM orders LEFT JOIN s ON o = o_orderkey)
SELECT prompt_id, 'o' || o AS id, round(score + CASE WHEN fate = 'class' THEN 0.25 * total ELSE 0 END, 6) AS score FROM c WHERE fate <> 'kids'
UNION ALL SELECT k.prompt_id, 'o' || k.o || '-' || k.n, round(k.score + CASE WHEN fate = 'kids' THEN 0.15 * c.score / c.n ELSE 0 END, 6) FROM k JOIN c USING (o) WHERE fate <> 'class'""")
def j9_containment(spark, sf_dir):
    """Orders as classes of their customer's file, lines as their methods."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("prompt_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.floor(F.col("o_totalprice").cast("double") / 4000).cast("double").alias("score"), (F.col("o_orderkey") % 700).alias("token_count"))
    m = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_symbol"), "l_linenumber").agg(F.max(F.col("l_extendedprice").cast("double")).alias("price"))
    m = m.join(o.select("prompt_id", F.col("id").alias("parent_symbol")), "parent_symbol")
    m = m.select("prompt_id", F.concat_ws("-", "parent_symbol", F.col("l_linenumber").cast("string")).alias("id"), F.floor(F.col("price") / 1000).cast("double").alias("score"), F.lit(90).cast("long").alias("token_count"), "parent_symbol", F.lit("method").alias("symbol_kind"))
    hits = o.withColumns({"parent_symbol": F.lit(None).cast("string"), "symbol_kind": F.lit("class")}).withColumn("token_count", F.col("token_count").cast("long")).unionByName(m)
    hits = hits.withColumns({"symbol_name": F.col("id"), "source_file": F.lit("f"), "exact": F.lit(False)})
    return rank.containment(hits).select("prompt_id", "id", F.round("score", 6).alias("score"))


@query("j3_embedding_fusion", KNN + """,
direct AS (SELECT prompt_id, id, CAST(10 + (id % 13) AS DOUBLE) AS score FROM s WHERE (id + prompt_id) % 11 = 0),
low AS (SELECT DISTINCT prompt_id FROM q WHERE prompt_id % 100 = 0),
o AS (SELECT n.*, row_number() OVER (PARTITION BY n.prompt_id ORDER BY rank) - 1 AS i FROM near n JOIN low USING (prompt_id)
      WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.prompt_id = n.prompt_id AND d.id = n.id))
SELECT d.prompt_id, d.id, round(CASE WHEN n.rank < 10 THEN d.score * (1.2 + 0.5 / (1 + n.rank)) ELSE d.score END, 6) AS score, CASE WHEN n.rank < 10 THEN 'boost' ELSE 'keep' END AS action
FROM direct d LEFT JOIN near n USING (prompt_id, id)
UNION ALL SELECT prompt_id, id, round(greatest(8, 14 - 1.5 * i), 6), 'insert' FROM o WHERE i < 5""")
def j3_embedding_fusion(spark, sf_dir):
    near = _near(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("prompt_id"), ((11 - F.col("vec_id") % 11) % 11).alias("rest"))  # stands for the prompts
    direct = v.join(small(q), F.col("vec_id") % 11 == F.col("rest")).select("prompt_id", F.col("vec_id").alias("id"), (10 + F.col("vec_id") % 13).cast("double").alias("score"))
    low = near.select("prompt_id").distinct().select("prompt_id", (F.col("prompt_id") % 100 == 0).alias("low"))
    return fuse.embedding_agreement(direct, near, low).withColumn("score", F.round("score", 6))


@query("f24_vector_math", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean FROM embeddings""")
def f24_vector_math(spark, sf_dir):
    from quarrion.functions import text as T

    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(T.dot(e, e)), 5).alias("norm"), r6(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(e), "mean"))


@query("w2_margins", """
SELECT o_custkey, round((m1 - m2) / m1, 6) AS margin FROM (
  SELECT o_custkey, max(o_totalprice) FILTER (k = 1) AS m1, max(o_totalprice) FILTER (k = 2) AS m2 FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) GROUP BY 1)""")
def w2_margins(spark, sf_dir):
    m = windows.margins(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")
    return m.select("o_custkey", r6(F.col("margin"), "margin"))
