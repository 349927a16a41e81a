"""Queries of content preparation, lookups, stores, registry and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.functions import content, text
from quarrion.operators import compiling, graph, packing, scope
from quarrion.plans import corpus
from quarrion.plans.corpus import sql
from quarrion.plans.rank_queries import FULL_SQL, full
from quarrion.plans.registry import query, table
from quarrion.plans.search_queries import BASE
from quarrion.sources import upkeep
from quarrion.streaming import jobs

STRINGS = "|".join(rf"{q}[^{q}\\]*(?:\\(?s:.)[^{q}\\]*)*(?:{q}|\\?\z)" for q in ('"', "''", "`")).replace("[^''\\\\]", "[^''\\\\]")


@query("f22_strip_comments", rf"""
SELECT page_id, md5(regexp_replace(regexp_replace(html, '({STRINGS})|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)', '\1', 'g'), '(?m)^\s*[\r\n]', '', 'g')) AS digest FROM pages""")
def f22_strip_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(content.strip_comments(F.col("html"))).alias("digest"))


@query("f21_minify_json", """
SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","tags":["a  b",{"user":' || user_id || '}]}' AS minified FROM events""")
def f21_minify_json(spark, sf_dir):
    spaced = F.concat(F.lit('{ "id" : '), "event_id", F.lit(',\n  "type":"'), "event_type", F.lit('" , "tags" : [ "a  b",\t{ "user": '), "user_id", F.lit(" } ]\n}"))
    return table(spark, sf_dir, "events").select("event_id", content.minify_json(spaced).alias("minified"))


@query("c17_test_files", """
SELECT page_id, regexp_matches(url || ['/a.ts', '/a.test.ts', '/fixtures/a', '/vitest.config.ts', '/b.Spec.js'][page_id % 5 + 1], '(?i)\\.(test|spec)\\.|vitest\\.config|/fixtures/') AS test FROM pages""".replace("\\\\", "\\"))
def c17_test_files(spark, sf_dir):
    tails = F.array(*map(F.lit, ("/a.ts", "/a.test.ts", "/fixtures/a", "/vitest.config.ts", "/b.Spec.js")))
    return table(spark, sf_dir, "pages").select("page_id", content.is_test_file(F.concat("url", F.get(tails, (F.col("page_id") % 5).cast("int")))).alias("test"))


WEAK = "[" + ",".join(f"'{w}'" for w in sorted(content.WEAK_SIGNALS)) + "]"


@query("c5_signal_terms", corpus.sql(rf"""
, w AS (SELECT prompt_id, list_filter(regexp_split_to_array(lower(prompt), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM prompts),
t AS (SELECT prompt_id, unnest(w) AS s FROM w),
v AS (SELECT prompt_id, unnest([s, regexp_replace(s, 'ing$', 'er'), regexp_replace(s, 'ing$', ''), regexp_replace(s, 'ion$', ''), regexp_replace(s, 'tion$', 't'), regexp_replace(s, 's$', '')]) AS x FROM t WHERE length(s) >= 3 AND NOT list_contains({WEAK}, s)),
a AS (SELECT DISTINCT prompt_id, x FROM (SELECT * FROM v UNION ALL SELECT prompt_id, unnest(w[1:2]) FROM w) WHERE length(x) BETWEEN 4 AND 63 AND NOT list_contains({WEAK}, x))
SELECT prompt_id, list_slice(list(x ORDER BY length(x) DESC, x), 1, 40) AS signals FROM a GROUP BY prompt_id""", "prompts"))
def c5_signal_terms(spark, sf_dir):
    p = corpus.prompts(spark, sf_dir).withColumn("w", text.words(F.col("prompt")))
    return p.select("prompt_id", content.signal_terms(F.col("w"), F.slice("w", 1, 2)).alias("signals"))


@query("f14_exact_tokens")
def f14_exact_tokens(spark, sf_dir):
    import public_tokenizers

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", content.exact_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("tokens"))


@query("c8_packing_order", corpus.sql(FULL_SQL + r""",
q AS (SELECT prompt_id, list_distinct(list_filter(regexp_split_to_array(lower(prompt), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 4)) AS u, list_filter(regexp_split_to_array(lower(prompt), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 4) AS terms FROM prompts),
h AS (SELECT *, CAST(ceil(length(content) / (4.5 - least(len(regexp_extract_all(content, '[{}()\[\];=<>]')) / greatest(length(content), 1), 0.5) * 3)) AS BIGINT) AS n FROM (
  SELECT hit.prompt_id, hit.id, hit.score, hit.source_file, hit.content, row_number() OVER (PARTITION BY hit.prompt_id ORDER BY hit.score DESC, hit.id) AS k FROM hit) WHERE k <= 25),
c AS (SELECT h.*, len(list_filter(q.terms, lambda t: contains(lower(h.content), t))) / greatest(len(q.terms), 1) AS coverage, list_contains(q.terms, lower(regexp_extract(h.source_file, '([^/]*)$', 1))) AS stem FROM h JOIN q USING (prompt_id)),
l AS (SELECT *, score / greatest(max(score) OVER (PARTITION BY prompt_id), 1e-9) + 1.5 * coverage + 0.5 * stem::INT - 0.4 * (n > 1200)::INT AS lead, stem OR coverage > 0 AS touch FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY lead DESC, id) AS r, first_value(source_file) OVER (PARTITION BY prompt_id ORDER BY lead DESC, id) AS file FROM l),
o AS (SELECT *, CASE WHEN r = 1 THEN 0 WHEN touch AND source_file = file THEN 1 WHEN touch THEN 2 WHEN source_file = file THEN 3 ELSE 4 END AS role FROM f)
SELECT prompt_id, id, CAST(role AS INTEGER) AS role, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY role, lead DESC, id) AS INTEGER) AS place FROM o""", *BASE))
def c8_packing_order(spark, sf_dir):
    """The leader, and in what order the other hits of each prompt follow."""
    p = corpus.prompts(spark, sf_dir).select("prompt_id", text.words(F.col("prompt")).alias("terms"), F.array().cast("array<string>").alias("identifiers"))
    h = compiling.top(full(spark, sf_dir), ["prompt_id"], [F.desc("score"), "id"], 25).withColumn("symbol_name", F.lit(None).cast("string"))
    return packing.ordered(h, p, 1200).select("prompt_id", "id", "role", "place")


@query("s13_lookup", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR FALSE UNION ALL SELECT p_partkey FROM part WHERE p_size IN (1, 2) AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def s13_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    by_list = upkeep.lookup(p, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), p_size=[1, 2])
    return upkeep.lookup(p, p_brand="Brand#11").select("p_partkey").unionByName(by_list.select("p_partkey"))


@query("s15_united_stores", """
SELECT CAST(id AS BIGINT) AS id, store FROM (SELECT s_suppkey AS id, 'project' AS store FROM supplier UNION ALL SELECT c_custkey, 'global' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))""")
def s15_united_stores(spark, sf_dir):
    near, far = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    return upkeep.united({"project": near, "global": far}).select("id", "store")


@query("f29_payload_links", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey % 11 = 3 OR l_partkey % 11 = 3) AND l_suppkey % 3 <> 2""")
def f29_payload_links(spark, sf_dir):
    evidence = F.array(F.struct(F.concat(F.lit("v"), F.col("l_suppkey") % 3).alias("view_id")))
    payload = F.to_json(F.struct(F.concat(F.lit("r"), F.col("l_orderkey") % 11).alias("source"), F.concat(F.lit("r"), F.col("l_partkey") % 11).alias("target"), evidence.alias("evidence")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", payload.alias("payload"))
    return graph.payload_links(rows, F.lit("r3"), "both", ["v0", "v1"]).select("l_orderkey", "l_linenumber")


@query("t9_reconcile_after_scan", "SELECT doc_id AS path FROM documents WHERE doc_id % 9 <> 4")
def t9_reconcile_after_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    whole = upkeep.reconciled_after(d, d.where("path % 9 <> 4"), True)
    return upkeep.reconciled_after(whole, d.limit(0), False)  # a scan that broke off changes nothing


@query("t2_replayed", "SELECT user_id AS path, arg_max(event_type, (epoch_us(ts), event_type)) AS type FROM events WHERE (SELECT count(*) FROM events) <= 1000000 GROUP BY 1")
def t2_replayed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("type"), "ts")
    return jobs.replayed(e, 1_000_000)[1].select("path", "type")


@query("k4_bind", "SELECT s_suppkey, 'v9' AS view_id, n > 0 AS needs_reindex FROM supplier, (SELECT count(*) AS n FROM nation)")
def k4_bind(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("v1").alias("view_id"))
    tables, identity = scope.bound({"files": t}, {"view_id": "v1", "root_path": "/old"}, {"view_id": "v9", "root_path": "/new"})
    return tables["files"].withColumn("needs_reindex", F.lit(identity["needs_reindex"]))


@query("k5_register", """
WITH o AS (SELECT 'w' || n_nationkey AS worktree_id, 'w' || n_nationkey || '@old' AS view_id FROM nation WHERE n_nationkey % 2 = 0),
f AS (SELECT 'w' || n_nationkey AS worktree_id, CASE WHEN n_nationkey % 4 = 0 THEN 'old' ELSE 'new' END AS branch FROM nation WHERE n_regionkey < 3)
SELECT f.worktree_id || '@' || f.branch AS view_id, TRUE AS active, CAST(CASE WHEN o.view_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS revision FROM f LEFT JOIN o ON o.view_id = f.worktree_id || '@' || f.branch
UNION ALL SELECT o.view_id, CASE WHEN f.worktree_id IS NULL THEN TRUE ELSE FALSE END, CASE WHEN f.worktree_id IS NULL THEN 1 ELSE 2 END FROM o LEFT JOIN f USING (worktree_id) WHERE f.branch IS NULL OR f.branch <> 'old'""")
def k5_register(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key, branch = F.concat(F.lit("w"), "n_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, "old").otherwise("new")
    project = F.concat(F.lit("p"), "n_regionkey")
    found = n.where("n_regionkey < 3").select(project.alias("project_id"), F.lit("x").alias("name"), key.alias("worktree_id"), F.lit("/r").alias("root_path"), branch.alias("branch"), F.lit("h2").alias("head"))
    one = F.lit(1).cast("long").alias("revision")
    half = n.where("n_nationkey % 2 = 0")
    dims = {
        "projects": half.select(project.alias("project_id"), F.lit("x").alias("name"), one).distinct(),
        "worktrees": half.select(key.alias("worktree_id"), project.alias("project_id"), F.lit("/r").alias("root_path"), one),
        "views": half.select(F.concat(key, F.lit("@old")).alias("view_id"), key.alias("worktree_id"), project.alias("project_id"), F.lit("old").alias("branch"), F.lit("h1").alias("head"), F.lit(True).alias("active"), one),
        "memberships": half.select(F.lit("g").alias("group_id"), project.alias("project_id")).distinct(),
    }
    return scope.registered(dims, found, "g")["views"].select("view_id", "active", "revision")


@query("g8_learned_imports", sql(FULL_SQL + """,
b AS (SELECT prompt_id, doc_id, view_id, max(score) AS score, min(id) AS id FROM hit GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS k FROM b),
t AS (SELECT prompt_id, doc_id, view_id, i, row_number() OVER (PARTITION BY prompt_id ORDER BY k, i) AS a FROM (SELECT *, unnest([0, 1, 2]) AS i FROM f WHERE k <= 3))
SELECT DISTINCT prompt_id, 'd' || doc_id AS source, 't' || ((doc_id + i) % 50) AS target FROM t WHERE a <= 6 AND (doc_id + i) % 3 <> 0 AND view_id <> ['en', 'de', 'fr', 'es'][(doc_id + i) % 4 + 1]""", *BASE))
def g8_learned_imports(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".ts"))
    h = full(spark, sf_dir).withColumn("source_file", F.concat(F.regexp_replace("source_file", r"\.txt$", ""), F.lit(".ts")))
    i = d.select(F.col("lang").alias("view_id"), path.alias("source_file"), F.concat(F.lit("d"), "doc_id").alias("source"), F.posexplode(F.array(*(F.concat(F.lit(f"./m{k}-"), "doc_id") for k in range(3)))).alias("k", "specifier"), "doc_id")
    i = i.withColumns({"mode": F.lit("import"), "local": F.lit(True), "n": F.col("doc_id") + F.col("k")})
    views = F.array(*map(F.lit, ("en", "de", "fr", "es")))
    resolved = i.where("n % 3 <> 0").select("view_id", "source", "specifier", "mode", F.concat(F.lit("t"), F.col("n") % 50).alias("target"), F.get(views, (F.col("n") % 4).cast("int")).alias("target_view"))
    return scope.learned_imports(h, i.drop("doc_id", "n"), resolved)[0].select("prompt_id", "source", "target").distinct()
