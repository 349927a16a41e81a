"""Queries of upkeep, scope, windows and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.functions import text as T
from quarrion.operators import expand, fulltext, retrieve, scan, scope, search, windows
from quarrion.operators.common import r6, small, stored, top
from quarrion.plans import corpus
from quarrion.plans.corpus import sql
from quarrion.plans.registry import query, table
from quarrion.plans.search_queries import BASE, BM25, hits
from quarrion.sources import purge, upkeep


def symbols(spark, sf_dir):
    """Parts as symbols: their names, types and brands."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.translate("p_name", " ", "_").alias("symbol_name"), "p_type", F.lower("p_brand").alias("file_stem"), F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), F.lower("p_type"), F.lit(".ts")).alias("source_file"), F.col("p_type").alias("parent_symbol"), F.when(F.col("p_size") % 2 == 0, "class").otherwise("field").alias("symbol_kind"), F.col("p_name").alias("section_title"))


def names(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "prompt_id long, name string")


NAMES = "WITH n AS (SELECT * FROM (VALUES {}) n(prompt_id, name)), p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', '_') AS s, lower(p_type) AS t, lower(p_brand) AS f, 'src/' || lower(p_brand) || '/' || lower(p_type) || '.ts' AS path, p_name, p_size FROM part)\n"


def values(xs):
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(xs))


SYMBOL_NAMES = ("small", "red_widget", "RED", "zzz")


@query("p2_symbol_prefix", NAMES.format(values(SYMBOL_NAMES)) + "SELECT prompt_id, id FROM (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY lower(s) = lower(name) DESC, id) AS k FROM n JOIN p ON starts_with(lower(s), lower(name))) WHERE k <= 20")
def p2_symbol_prefix(spark, sf_dir):
    return retrieve.by_symbol(symbols(spark, sf_dir), names(spark, SYMBOL_NAMES)).select("prompt_id", "id")


@query("p3_symbol_contains", NAMES.format(values(("widget", "all_r", "_ring", "ring"))) + "SELECT prompt_id, id FROM (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY id) AS k FROM n JOIN p ON length(name) >= 5 AND contains(lower(s), lower(name))) WHERE k <= 15")
def p3_symbol_contains(spark, sf_dir):
    return retrieve.by_symbol_part(symbols(spark, sf_dir), names(spark, ("widget", "all_r", "_ring", "ring"))).select("prompt_id", "id")


@query("p4_parent_symbol", NAMES.format(values(("economy", "STANDARD", "none"))) + "SELECT prompt_id, id FROM (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY id) AS k FROM n JOIN p ON t = lower(name)) WHERE k <= 30")
def p4_parent_symbol(spark, sf_dir):
    return retrieve.by_parent(symbols(spark, sf_dir), names(spark, ("economy", "STANDARD", "none"))).select("prompt_id", "id")


@query("p5_title_contains", NAMES.format(values(("widget", "red", "ll r"))) + "SELECT prompt_id, id FROM (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id, name ORDER BY id) AS k FROM n JOIN p ON contains(lower(p_name), name)) WHERE k <= 5")
def p5_title_contains(spark, sf_dir):
    return retrieve.by_title(symbols(spark, sf_dir), names(spark, ("widget", "red", "ll r")).withColumnRenamed("name", "term")).select("prompt_id", "id")


@query("p6_stem_rank", NAMES.format(values(("brand#2", "and#1", "economy"))) + """SELECT prompt_id, id, CAST(r AS BIGINT) AS stem_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY r DESC, k DESC, id) AS rn FROM (
    SELECT prompt_id, id, CASE WHEN f = name THEN 3 WHEN starts_with(f, name) THEN 2 WHEN contains(f, name) OR contains(path, name) THEN 1 ELSE 0 END AS r, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS k FROM n CROSS JOIN p) WHERE r > 0) WHERE rn <= 20""")
def p6_stem_rank(spark, sf_dir):
    s = names(spark, ("brand#2", "and#1", "economy")).withColumnRenamed("name", "v")
    return retrieve.by_stem(symbols(spark, sf_dir), s).select("prompt_id", "id", F.col("stem_rank").cast("long").alias("stem_rank"))


@query("j10_class_children", NAMES.format(values(("small", "red"))) + """,
h AS (SELECT prompt_id, name, s FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, name ORDER BY lower(s) = lower(name) DESC, id) AS k FROM n JOIN p ON starts_with(lower(s), lower(name))) WHERE k <= 20 AND p_size % 2 = 0),
c AS (SELECT DISTINCT prompt_id, name, s FROM h), d AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, name ORDER BY length(s) DESC, s) AS k FROM c)
SELECT prompt_id, count(*) AS n_classes FROM d WHERE k <= 3 GROUP BY prompt_id""".replace(",\nh AS", ", h AS").replace(")\n, h AS", "), h AS"))
def j10_class_children(spark, sf_dir):
    from quarrion import config

    hits = retrieve.by_symbol(symbols(spark, sf_dir), names(spark, ("small", "red")))
    classes = hits.where("symbol_kind = 'class'").select("prompt_id", "name", "symbol_name").distinct()
    return top(classes, ["prompt_id", "name"], [F.desc(F.length("symbol_name")), "symbol_name"], config.CLASS_CHILDREN).groupBy("prompt_id").agg(F.count("*").alias("n_classes"))


@query("j10_children", NAMES.format(values(("small", "red"))) + """,
h AS (SELECT prompt_id, name, s FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, name ORDER BY lower(s) = lower(name) DESC, id) AS k FROM n JOIN p ON starts_with(lower(s), lower(name))) WHERE k <= 20 AND p_size % 2 = 0),
c AS (SELECT DISTINCT prompt_id, name, s FROM h), d AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, name ORDER BY length(s) DESC, s) AS k FROM c)
SELECT prompt_id, id FROM (SELECT e.prompt_id, p.id, row_number() OVER (PARTITION BY e.prompt_id, e.s ORDER BY p.id) AS k FROM (SELECT DISTINCT prompt_id, s FROM d WHERE k <= 3) e JOIN p ON lower(p.s) = lower(e.s)) WHERE k <= 30""".replace(",\nh AS", ", h AS").replace(")\n, h AS", "), h AS"))
def j10_children(spark, sf_dir):
    """Parts of a name are its members; a class is found by its name's start."""
    s = symbols(spark, sf_dir).withColumn("parent_symbol", F.col("symbol_name"))
    return retrieve.class_children(s, retrieve.by_symbol(s, names(spark, ("small", "red"))))


@query("p1_layer_filter", sql("\nSELECT layer, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks WHERE layer IN ('repo', 'session') GROUP BY layer", "chunks"))
def p1_layer_filter(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).where(F.col("layer").isin("repo", "session")).groupBy("layer").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 < 8").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("hash"))
    new = d.where("doc_id % 10 > 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return old, new


VERSIONS = "WITH o AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 < 8), n AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 > 0)\n"


@query("p7_changed_files", VERSIONS + "SELECT n.path, CASE WHEN o.path IS NULL THEN 'add' ELSE 'change' END AS action FROM n LEFT JOIN o USING (path) WHERE o.hash IS DISTINCT FROM n.hash")
def p7_changed_files(spark, sf_dir):
    return upkeep.changed(*_versions(spark, sf_dir))


@query("j14_reconcile", VERSIONS + "SELECT path FROM o WHERE path NOT IN (SELECT path FROM n)")
def j14_reconcile(spark, sf_dir):
    return upkeep.stale(*_versions(spark, sf_dir)).select("path")


@query("s16_upsert", VERSIONS + "SELECT path, hash FROM n UNION ALL SELECT path, hash FROM o WHERE path NOT IN (SELECT path FROM n)")
def s16_upsert(spark, sf_dir):
    return upkeep.upserted(*_versions(spark, sf_dir), ["path"])


@query("s25_remove_file", sql("\nSELECT source_file, count(*) AS n FROM chunks WHERE doc_id % 13 <> 0 GROUP BY ALL", "chunks"))
def s25_remove_file(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    gone = c.where("doc_id % 13 = 0").select("source_file").distinct()
    return upkeep.removed(c, gone, "source_file").groupBy("source_file").agg(F.count("*").alias("n"))


@query("j15_live_vectors", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def j15_live_vectors(spark, sf_dir):
    live = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(live, "vec_id", "left_semi").select("vec_id")


@query("j18_active_view", """
WITH v AS (SELECT 'v' || n_nationkey AS view_id, '/r' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '/n' || n_nationkey ELSE '' END AS root FROM nation),
p AS (SELECT DISTINCT '/r' || n_regionkey || '/n' || n_nationkey || '/c' || (c_custkey % 7) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT path, view_id FROM (SELECT path, view_id, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC, view_id) AS k FROM p JOIN v ON path = root OR starts_with(path, root || '/')) WHERE k = 1""")
def j18_active_view(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    r, k = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    views = n.select(F.concat(F.lit("v"), k).alias("view_id"), F.concat(F.lit("/r"), r, F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("/n"), k)).otherwise("")).alias("root_path"))
    paths = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/r"), r, F.lit("/n"), k, F.lit("/c"), (F.col("c_custkey") % 7).cast("string")).alias("path")).distinct()
    return scope.active_view(paths, views)


@query("j19_members", """
SELECT n_regionkey AS project_id, min(CASE WHEN active THEN s_suppkey END) AS first_active, count(*) AS n FROM (SELECT n_regionkey, s_suppkey, s_suppkey % 3 = 0 AS active FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3) GROUP BY 1""")
def j19_members(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    views = s.select(F.col("n_regionkey").alias("project_id"), F.col("s_suppkey").alias("view_id"), (F.col("s_suppkey") % 3 == 0).alias("active"))
    groups = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project_id"), F.when(F.col("r_regionkey") < 3, "g").otherwise("h").alias("group"))
    first = scope.members(views, groups, "g").select("project_id", F.when(F.col("active"), F.col("view_id")).alias("first_active"))
    return scope.members(views, groups, "g", True).groupBy("project_id").agg(F.count("*").alias("n")).join(first, "project_id")


@query("o5_federated_top", """
WITH h AS (SELECT c_nationkey % 5 AS prompt_id, c_mktsegment AS view_id, c_custkey AS id, c_acctbal AS score FROM customer),
x AS (SELECT prompt_id, view_id, id, CASE WHEN view_id = 'BUILDING' THEN score * 1.1 ELSE score END AS score FROM h)
SELECT prompt_id, view_id, id, round(score, 4) AS score, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, view_id, id) AS k FROM x) WHERE k <= 25""")
def o5_federated_top(spark, sf_dir):
    h = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("prompt_id"), F.col("c_mktsegment").alias("view_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    active = h.select("prompt_id").distinct().withColumn("active_view", F.lit("BUILDING"))
    return scope.federated(h, active).select("prompt_id", "view_id", "id", F.round("score", 4).alias("score"), "rank")


@query("p14_scope_predicate", """
SELECT o_orderkey, n FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, bool_and(l_linenumber <= 5) AS ok FROM lineitem GROUP BY 1) WHERE ok""")
def p14_scope_predicate(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("view_id"))).alias("evidence"))
    return g.where(F.forall("evidence", lambda e: e["view_id"] <= 5)).select("o_orderkey", F.size("evidence").cast("long").alias("n"))


@query("p15_path_confinement", """
SELECT event_id, p = '/root/w' OR starts_with(p, '/root/w/') AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AS ok FROM (SELECT event_id, ['/root/w', '/root/w/a', '/root/wide/a', '/root/w/../x', '/etc', '/root/w/b..c'][event_id % 6 + 1] AS p FROM events)""")
def p15_path_confinement(spark, sf_dir):
    p = F.get(F.array(*map(F.lit, ("/root/w", "/root/w/a", "/root/wide/a", "/root/w/../x", "/etc", "/root/w/b..c"))), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scope.inside(p, F.lit("/root/w")).alias("ok"))


@query("k2_reconcile_views", """
WITH v AS (SELECT s_suppkey AS view_id, s_nationkey AS branch FROM supplier WHERE s_suppkey % 4 <> 0), f AS (SELECT s_suppkey AS view_id, CASE WHEN s_suppkey % 5 = 0 THEN 99 ELSE s_nationkey END AS branch FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT view_id, CASE WHEN v.branch IS NULL THEN 'add' WHEN f.branch IS NULL THEN 'remove' WHEN v.branch <> f.branch THEN 'drop-branch' ELSE 'keep' END AS action FROM v FULL OUTER JOIN f USING (view_id)""")
def k2_reconcile_views(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view_id"), F.col("s_nationkey").alias("branch"))
    found = s.where("view_id % 3 <> 0").withColumn("branch", F.when(F.col("view_id") % 5 == 0, 99).otherwise(F.col("branch")))
    return scope.reconciled(s.where("view_id % 4 <> 0"), found)


@query("k6_purge_views", "SELECT c_nationkey AS view_id, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1")
def k6_purge_views(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "view_id")
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("view_id"))
    return scope.without_views({"c": c}, gone)["c"].groupBy("view_id").agg(F.count("*").alias("n"))


@query("k6_cleanup_actions", """
WITH v AS (SELECT 'v' || s_suppkey AS view_id, 't' || s_nationkey AS worktree_id, 'p' || n_regionkey AS project_id, 'b' || (s_suppkey % 7) AS branch, s_acctbal > 5000 AS active FROM supplier JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT 't' || n_nationkey AS worktree_id FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 1),
b AS (SELECT DISTINCT 'p' || n_regionkey AS project_id, 'b' || (c_custkey % 5) AS branch FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 4)
SELECT 'worktree' AS kind, worktree_id AS id, project_id, view_id, 'worktree is gone' AS reason FROM v WHERE worktree_id IN (SELECT worktree_id FROM t)
UNION ALL SELECT 'branch', view_id, project_id, view_id, 'branch is gone' FROM v WHERE NOT active AND worktree_id NOT IN (SELECT worktree_id FROM t) AND project_id IN (SELECT project_id FROM b) AND (project_id, branch) NOT IN (SELECT (project_id, branch) FROM b)""")
def k6_cleanup_actions(spark, sf_dir):
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", of("p", "n_regionkey").alias("project_id"))
    v = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("s_suppkey") % 7)
    v = v.select(of("v", "s_suppkey").alias("view_id"), of("t", "s_nationkey").alias("worktree_id"), "project_id", of("b", "k").alias("branch"), (F.col("s_acctbal") > 5000).alias("active"))
    trees = n.select(of("t", "n_nationkey").alias("worktree_id"), (F.col("n_nationkey") % 3 == 0).alias("removed"), (F.col("n_nationkey") % 2 == 0).alias("locked"))
    branches = table(spark, sf_dir, "customer").join(n.where("project_id <> 'p4'"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("c_custkey") % 5).select("project_id", of("b", "k").alias("branch")).distinct()
    return purge.actions(v, trees, branches)


@query("w8_same_file_runs", """
WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM y GROUP BY ALL""")
def w8_same_file_runs(spark, sf_dir):
    x = windows.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return x.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("w10_window_merge", sql("""
, hit AS (SELECT DISTINCT c.doc_id, greatest(c.line - 1, 0) AS s, c.line + 1 AS e FROM chunks c WHERE length(c.content) % 7 = 0),
x AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hit),
y AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT doc_id, min(s) AS first_line, max(e) AS last_line FROM y GROUP BY doc_id, island""", "chunks"))
def w10_window_merge(spark, sf_dir):
    hits = corpus.chunks(spark, sf_dir).where(F.length("content") % 7 == 0).select("doc_id", F.greatest(F.col("line") - 1, F.lit(0)).alias("s"), (F.col("line") + 1).alias("e")).distinct()
    return upkeep.merged_windows(hits, ["doc_id"]).select("doc_id", F.col("s").alias("first_line"), F.col("e").alias("last_line"))


@query("w13_dup_titles", """SELECT p_partkey, p_name || CASE WHEN k = 1 THEN '' ELSE '#dup' || (k - 1) END AS title FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part)""")
def w13_dup_titles(spark, sf_dir):
    return upkeep.unique_titles(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", F.col("p_name").alias("title"))


@query("w14_burst", """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 4""")
def w14_burst(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).where("n >= 4").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


@query("t6_latest_per_path", "SELECT user_id AS path, arg_max(event_type, (epoch_us(ts), event_id)) AS last_type, count(*) AS n FROM events GROUP BY 1")
def t6_latest_per_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("type"), "ts", "event_id")
    return upkeep.latest(e, "path", "ts", "event_id").join(e.groupBy("path").agg(F.count("*").alias("n")), "path").select("path", F.col("type").alias("last_type"), "n")


@query("w9_sections", sql("""
, x AS (SELECT doc_id, line, sum(CASE WHEN length(content) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM chunks)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n, min(line) AS first_line FROM x GROUP BY ALL""", "chunks"))
def w9_sections(spark, sf_dir):
    x = windows.sections(corpus.chunks(spark, sf_dir), ["doc_id"], ["line"], F.length("content") < 60)
    return x.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("w7_prefix_budget", sql("""
, x AS (SELECT doc_id, line, sum(token_count) OVER (PARTITION BY doc_id ORDER BY line) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM chunks)
SELECT doc_id, count(*) AS n FROM x WHERE used <= 120 OR k = 1 GROUP BY doc_id""", "chunks"))
def w7_prefix_budget(spark, sf_dir):
    return windows.within_budget(corpus.chunks(spark, sf_dir), ["doc_id"], ["line"], "token_count", 120).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("c14_term_windows", sql("""
, hit AS (SELECT DISTINCT doc_id, greatest(line - 5, 0) AS s, line + 5 AS e FROM chunks WHERE contains(lower(content), 'stupid') OR contains(lower(content), 'license')),
x AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hit),
y AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT doc_id, min(s) AS s, max(e) AS e FROM y GROUP BY doc_id, island""", "chunks"))
def c14_term_windows(spark, sf_dir):
    low = F.lower("content")
    hits = corpus.chunks(spark, sf_dir).where(F.contains(low, F.lit("stupid")) | F.contains(low, F.lit("license"))).select("doc_id", F.greatest(F.col("line") - 5, F.lit(0)).alias("s"), (F.col("line") + 5).alias("e")).distinct()
    return upkeep.merged_windows(hits, ["doc_id"])


@query("c14_expanded", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) <= 2097152),
h AS (SELECT *, CASE WHEN contains(lower(l), 'stupid') OR contains(lower(l), 'license') THEN line END AS hit FROM l),
n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM h),
p AS (SELECT doc_id, line, CASE WHEN lag(line) OVER w < line - 1 THEN chr(10) || '// ...' || chr(10) || chr(10) ELSE '' END || substring(l, 1, 65536) || chr(10) AS piece FROM n WHERE near IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
u AS (SELECT doc_id, line, piece, sum(length(piece)) OVER w AS c, sum(len(regexp_extract_all(piece, '[{}()\[\];=<>]'))) OVER w AS s FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
k AS (SELECT *, CAST(ceil(c / (4.5 - least(s / greatest(c, 1), 0.5) * 3)) AS BIGINT) AS used FROM u),
g AS (SELECT doc_id, string_agg(piece, '' ORDER BY line) FILTER (used <= 2000) AS content, max(used) FILTER (used <= 2000) AS tokens, max(used) AS whole FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN octet_length(encode(text)) > 2097152 THEN 'too large' WHEN whole IS NULL THEN 'no match' WHEN whole > 2000 THEN 'cut' ELSE 'whole' END AS status, coalesce(tokens, 0) AS tokens, md5(coalesce(content, '')) AS content
FROM documents LEFT JOIN g USING (doc_id)""")
def c14_expanded(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request"), F.lit("d").alias("path"), F.lit(0).alias("k"), "text")
    terms = d.select("request", F.explode(F.array(F.lit("Stupid"), F.lit("LICENSE"))).alias("term"), F.lit(0).alias("k"))
    return expand.expanded(d, terms).select(F.col("request").alias("doc_id"), "status", "tokens", F.md5("content").alias("content"))


@query("s21_line_range", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents")
def s21_line_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", upkeep.line_range(F.col("text"), 2, 3).alias("lines"))


@query("a15_recall", sql(BM25 + r""",
top AS (SELECT DISTINCT prompt_id, source_file FROM (SELECT bm.prompt_id, c.source_file, row_number() OVER (PARTITION BY bm.prompt_id ORDER BY round(score, 9) DESC, bm.id) AS k FROM bm JOIN chunks c USING (id)) WHERE k <= 15),
q AS (SELECT prompt_id, list_filter(regexp_split_to_array(lower(prompt), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM prompts),
t AS (SELECT source_file, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS c FROM chunks),
expected AS (SELECT DISTINCT q.prompt_id, t.source_file FROM q JOIN t ON contains(t.c, ' ' || array_to_string(q.w, ' ') || ' '))
SELECT e.prompt_id, count(*) AS n_expected, count(top.source_file) AS n_found, round(count(top.source_file) / least(count(*), 15), 6) AS recall
FROM expected e LEFT JOIN top USING (prompt_id, source_file) GROUP BY ALL""", *BASE))
def a15_recall(spark, sf_dir):
    c, p = corpus.chunks(spark, sf_dir), corpus.prompts(spark, sf_dir)
    files = c.select("id", "source_file")
    q = p.select("prompt_id", T.words(F.col("prompt")).alias("words"), F.lit("content").alias("col"))
    found = scan.phrases(c, q)
    found = fulltext.phrases(corpus.indexes(spark, sf_dir).text, q) if found is None else found
    expected = files.join(small(stored(found)), "id").select("prompt_id", "source_file").distinct()
    best = files.join(small(stored(search.top_hits(hits(spark, sf_dir, 15).withColumn("score", F.round("score", 9)), 15))), "id")
    return search.recall(expected, best, 15).withColumn("recall", F.round("recall", 6))
