"""Queries of the graph, of memory and of usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion import config
from quarrion.functions import text as T
from quarrion.operators import graph, memory
from quarrion.operators.common import r6, top
from quarrion.plans import corpus
from quarrion.plans.corpus import sql
from quarrion.plans.registry import query, table

BOTH = """,
sym AS (SELECT source AS node, target AS neighbour, type, weight, 'out' AS direction FROM edges UNION ALL SELECT target, source, type, weight, 'in' FROM edges)"""


def seeds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0")
    return o.select(F.col("o_orderkey").alias("prompt_id"), F.concat(F.lit("order:"), "o_orderkey").alias("node"))


@query("g3_neighbours", sql(BOTH + "\nSELECT node, neighbour, type, round(weight, 6) AS weight, direction FROM sym WHERE node IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0)", "edges"))
def g3_neighbours(spark, sf_dir):
    return graph.neighbours(corpus.edges(spark, sf_dir), seeds(spark, sf_dir))


@query("j12_edge_degrees", sql(BOTH + "\nSELECT node, count(DISTINCT neighbour) AS degree, round(max(weight), 6) AS heaviest FROM sym GROUP BY node", "edges"))
def j12_edge_degrees(spark, sf_dir):
    return graph.both_ways(corpus.edges(spark, sf_dir)).groupBy("node").agg(F.count_distinct("neighbour").alias("degree"), F.max("weight").alias("heaviest"))


G2 = """,
s AS (SELECT 'order:' || o_orderkey AS node, o_orderkey AS prompt_id FROM orders WHERE o_orderkey % 100 = 0),
e0 AS (SELECT node, neighbour, max(weight) AS weight FROM sym WHERE weight >= 0.5 GROUP BY ALL),
e AS (SELECT * FROM e0 WHERE node IN (SELECT node FROM e0 GROUP BY node HAVING count(*) <= 30) AND length(neighbour) >= 3),
l1 AS (SELECT prompt_id, neighbour AS node, max(weight) * 0.5 AS score FROM s JOIN e USING (node) WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.prompt_id = s.prompt_id AND t.node = e.neighbour) GROUP BY ALL),
l2 AS (SELECT l1.prompt_id, neighbour AS node, max(weight) * 0.25 AS score FROM l1 JOIN e USING (node)
       WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.prompt_id = l1.prompt_id AND t.node = e.neighbour) AND NOT EXISTS (SELECT 1 FROM l1 t WHERE t.prompt_id = l1.prompt_id AND t.node = e.neighbour) GROUP BY ALL),
x AS (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY depth, score DESC, node) AS k FROM x)"""


@query("g2_expand_levels", sql(BOTH + G2 + "\nSELECT prompt_id, node, CAST(depth AS BIGINT) AS depth, round(score, 6) AS score FROM r WHERE k <= 20", "edges"))
def g2_expand_levels(spark, sf_dir):
    return graph.expanded(corpus.repeated_edges(spark, sf_dir), seeds(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("g2_expand_best_first")
def g2_expand_best_first(spark, sf_dir):
    return graph.expanded_exactly(corpus.repeated_edges(spark, sf_dir), seeds(spark, sf_dir))


@query("g5_trace", """
WITH l AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
s AS (SELECT o_orderkey AS prompt_id, 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 100 = 0)
SELECT s.prompt_id, c.target AS node, CAST(3 AS BIGINT) AS depth, s.node || '>' || a.target || '>' || b.target || '>' || c.target AS path
FROM s JOIN l a ON a.source = s.node JOIN l b ON b.source = a.target JOIN l c ON c.source = b.target
UNION ALL SELECT s.prompt_id, b.target, 2, s.node || '>' || a.target || '>' || b.target FROM s JOIN l a ON a.source = s.node JOIN l b ON b.source = a.target
UNION ALL SELECT s.prompt_id, a.target, 1, s.node || '>' || a.target FROM s JOIN l a ON a.source = s.node""")
def g5_trace(spark, sf_dir):
    def pair(name, a, b, x, y):
        return table(spark, sf_dir, name).select(F.lit("v").alias("view_id"), F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit("fk").alias("type"))

    links = pair("customer", "c", "n", "c_custkey", "c_nationkey").unionByName(pair("nation", "n", "r", "n_nationkey", "n_regionkey")).unionByName(pair("orders", "o", "c", "o_orderkey", "o_custkey"))
    s = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("prompt_id"), F.lit("v").alias("view_id"), F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.traced(links, s, depth=4).withColumn("path", F.array_join("path", ">"))


@query("g5_trace_limits", """
WITH l AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS node, 'c' || c_custkey AS next FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) AS k, count(*) OVER (PARTITION BY node) AS n FROM l),
s AS (SELECT n_nationkey AS prompt_id, 'n' || n_nationkey AS node FROM nation),
-- The first 14 links of a nation bring a node each, which fills the budget of 15 with the nation itself; 20 links are looked at.
one AS (SELECT s.prompt_id, s.node, r.next, r.k, r.n FROM s JOIN r USING (node) WHERE r.k <= 14),
two AS (SELECT o.prompt_id, o.node, o.next, o.k, count(r.id) AS n FROM one o LEFT JOIN r ON r.node = o.next GROUP BY ALL)
SELECT prompt_id, 'path' AS kind, node || '>' || next AS refs, NULL AS reason FROM two WHERE k <= 5
UNION ALL SELECT prompt_id, 'path', node, NULL FROM s WHERE node NOT IN (SELECT node FROM r)
UNION ALL SELECT prompt_id, 'stop', next, 'path_limit' FROM two WHERE k > 5
UNION ALL SELECT prompt_id, 'stop', next, CASE WHEN n = 0 THEN 'no_recorded_connection' ELSE 'depth_limit' END FROM two
UNION ALL SELECT prompt_id, 'stop', next, 'edge_limit' FROM two WHERE n > 20
UNION ALL SELECT DISTINCT prompt_id, 'stop', node, 'edge_limit' FROM one WHERE n > 20
UNION ALL SELECT DISTINCT prompt_id, 'stop', node, 'node_limit' FROM one WHERE n > 14
UNION ALL SELECT prompt_id, 'stop', node, 'no_recorded_connection' FROM s WHERE node NOT IN (SELECT node FROM r)""")
def g5_trace_limits(spark, sf_dir):
    """Who is in a nation, and with what orders: searches that end by every limit."""
    def way(name, a, b, x, y):
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), x).alias("id"), F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit("fk").alias("type"), F.lit("valid").alias("status"))

    links = way("customer", "c", "n", "c_custkey", "c_nationkey").unionByName(way("orders", "o", "c", "o_orderkey", "o_custkey"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("prompt_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"))
    found = graph.trace(links, s, direction="incoming", depth=1, nodes=15, edges=20, paths=5)
    return found.select("prompt_id", "kind", F.array_join("refs", ">").alias("refs"), "reason")


@query("g1_extracted_edges", """
WITH p AS (SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS name, 'B' || replace(lower(p_brand), '#', '') AS brand, lower(split_part(p_type, ' ', 1)) AS kind, p_size FROM part)
SELECT lower(name) AS source, 'queue:' || kind AS target, 'references' AS type, CAST(1.0 AS DOUBLE) AS weight, p_partkey AS source_chunk_id FROM p
UNION ALL SELECT lower(name), 'table:' || lower(brand), 'references', 1.0, p_partkey FROM p
UNION ALL SELECT 'part-' || p_partkey, kind || '-maker', 'depends_on', 2.0, p_partkey FROM p
UNION ALL SELECT 'part-' || p_partkey, kind, 'produces', 2.0, p_partkey FROM p
UNION ALL SELECT 'load' || p_size, brand || 'Store', 'uses', 0.8, p_partkey FROM p
UNION ALL SELECT 'load' || p_size, name, 'uses', 0.8, p_partkey FROM p
UNION ALL SELECT 'load' || p_size, kind || '/lib', 'imports', 2.0, p_partkey FROM p""")
def g1_extracted_edges(spark, sf_dir):
    """A chunk of code about each part, and the edges in it."""
    kind, brand = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.concat(F.lit("B"), F.translate(F.lower("p_brand"), "#", ""))
    p = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # short rows, of which a file's one row group has very many
    key = F.col("p_partkey").cast("string")
    content = F.concat(
        F.lit("reads queue:"), kind, F.lit(" and table:"), F.lower(brand), F.lit("\npart-"), key, F.lit(" depends on "), kind, F.lit("-maker\npart-"), key, F.lit(" produces "), kind,
        F.lit("\nlet x = require('"), kind, F.lit("/lib')\n"), brand, F.lit("Store()"),
    )
    c = p.select(F.col("p_partkey").alias("id"), F.upper(F.translate("p_name", " ", "_")).alias("title"), content.alias("content"), F.lit("code").alias("file_type"), F.concat(F.lit("load"), "p_size").alias("symbol_name"))
    return graph.extracted(c)


@query("p10_quality_entities", sql("""
SELECT term, count(*) AS n FROM words WHERE length(term) >= 3 AND NOT regexp_matches(term, '^\\d+$') AND NOT list_contains(""".replace("\\\\", "\\") + corpus.STOP + ", term) GROUP BY term", "chunks", "words"))
def p10_quality_entities(spark, sf_dir):
    w = corpus.chunks(spark, sf_dir).select(F.explode(T.words(F.col("content"))).alias("term"))
    return w.where(graph.quality_entity(F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))


@query("g10_unlink", sql("\nSELECT type, count(*) AS n FROM edges WHERE target NOT IN ('region:1', 'nation:3') GROUP BY ALL", "edges"))
def g10_unlink(spark, sf_dir):
    e = corpus.edges(spark, sf_dir)
    gone = spark.createDataFrame([("region:1",), ("nation:3",)], "target string")
    return e.join(F.broadcast(gone), "target", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query("s20_graph_nodes", sql("\nSELECT substr(md5(node), 1, 8) AS node_id, min(node) AS label, count(*) AS n FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1", "edges"))
def s20_graph_nodes(spark, sf_dir):
    e = corpus.edges(spark, sf_dir)
    n = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node")))
    return n.groupBy(F.substring(F.md5("node"), 1, 8).alias("node_id")).agg(F.min("node").alias("label"), F.count("*").alias("n"))


def facts(spark, sf_dir):
    """Benchmark passages as facts, with ages and confidences from their ids."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    return b.select(i.alias("id"), F.col("text").alias("fact"), F.lit("general").alias("category"), ((i % 10) / 10.0).alias("confidence"), (i * 0).alias("created_at"), (i * memory.DAY).alias("last_accessed"), (i % 3).alias("access_count"))


FACTS = """WITH facts AS (SELECT item_id AS id, text AS fact, 'general' AS category, (item_id % 10) / 10.0 AS confidence, 0 AS created_at, item_id * 86400000 AS last_accessed, item_id % 3 AS access_count FROM benchmark)"""


@query("m1_learn", FACTS + """,
n AS (SELECT fact, count(*) AS n, max(t) AS last, min(t) AS first FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM benchmark WHERE item_id = doc_id % 7) ELSE source END AS fact, doc_id AS t FROM documents) GROUP BY fact)
SELECT md5(fact) AS fact, round(CASE WHEN f.id IS NULL THEN 1.0 ELSE least(f.confidence + 0.1 * coalesce(n.n, 0), greatest(f.confidence, 1.0)) END, 6) AS confidence, greatest(f.last_accessed, n.last) AS last_accessed
FROM facts f FULL OUTER JOIN n USING (fact)""")
def m1_learn(spark, sf_dir):
    known = F.broadcast(table(spark, sf_dir, "benchmark").where("item_id < 7").select(F.col("item_id").alias("k"), F.col("text").alias("t")))  # seven rows
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 7).join(known, "k", "left")
    new = d.select(F.when(F.col("doc_id") % 3 == 0, F.col("t")).otherwise(F.col("source")).alias("fact"), F.lit("general").alias("category"), F.col("doc_id").alias("at"))
    return memory.learned(facts(spark, sf_dir).drop("id"), new).select(F.md5("fact").alias("fact"), r6(F.col("confidence"), "confidence"), "last_accessed")


@query("m2_decay", FACTS + """,
x AS (SELECT *, CASE WHEN 40 * 86400000 - last_accessed > 7 * 86400000 THEN greatest(confidence - 0.05, least(confidence, 0.1)) ELSE confidence END AS c FROM facts)
SELECT id, round(c, 6) AS confidence FROM x WHERE NOT (c < 0.15 AND 40 * 86400000 - last_accessed > 30 * CAST(86400000 AS BIGINT))""".replace("40 * 86400000", "40 * CAST(86400000 AS BIGINT)"))
def m2_decay(spark, sf_dir):
    return memory.decayed(facts(spark, sf_dir), F.lit(40 * memory.DAY)).select("id", r6(F.col("confidence"), "confidence"))


@query("m3_forget", FACTS + "\nSELECT id, access_count FROM facts WHERE id % 4 <> 0")
def m3_forget(spark, sf_dir):
    f = facts(spark, sf_dir)
    return memory.forgotten(f, f.where("id % 4 = 0").select("id")).select("id", "access_count")


@query("x7_fact_access", FACTS + ", r AS (SELECT user_id % 40 AS id, count(*) AS n, max(event_id) AS t FROM events GROUP BY 1)\nSELECT f.id, f.access_count + coalesce(r.n, 0) AS access_count, greatest(f.last_accessed, coalesce(r.t, f.last_accessed)) AS last_accessed FROM facts f LEFT JOIN r USING (id)")
def x7_fact_access(spark, sf_dir):
    reads = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("id"), F.col("event_id").alias("at"))
    return memory.accessed(facts(spark, sf_dir), reads).select("id", "access_count", "last_accessed")


@query("o3_fact_search", FACTS + "\nSELECT category, id, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, last_accessed DESC, id) AS k FROM facts WHERE confidence > 0.3) WHERE k <= 5")
def o3_fact_search(spark, sf_dir):
    return top(facts(spark, sf_dir).where("confidence > 0.3"), ["category"], [F.desc("confidence"), F.desc("last_accessed"), "id"], 5, "rank").select("category", "id", "rank")


@query("m4_importance", """
SELECT source AS path, CAST(least(greatest(5 + sum(CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN -1 ELSE 0 END), 1), 10) AS BIGINT) AS importance
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def m4_importance(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("path")).distinct().withColumn("importance", F.lit(5).cast("long"))
    ratings = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("path"), (F.col("quality") == 1).alias("up"))
    return memory.file_importance(files, ratings).select("path", F.col("importance").cast("long").alias("importance"))


MEM = FACTS + r""",
ev AS (SELECT event_id AS id, event_type, event_type || ' ' || user_id AS content FROM events),
pr AS (SELECT item_id AS prompt_id, CASE WHEN item_id % 2 = 0 THEN 'fix' ELSE 'general' END AS intent, list_distinct(list_append(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), 'error')) AS terms FROM benchmark),
items AS (SELECT 'fact' AS kind, CAST(id AS VARCHAR) AS id, fact AS content, confidence * 10 AS score FROM facts WHERE confidence >= 0.6
  UNION ALL SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'event' END, CAST(id AS VARCHAR), content, 5.0 FROM ev),
w AS (SELECT kind, id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term FROM items),
t AS (SELECT prompt_id, intent, unnest(terms) AS term FROM pr),
h AS (SELECT t.prompt_id, t.intent, w.kind, w.id, count(*) AS shared FROM w JOIN t USING (term) WHERE length(term) > 3 GROUP BY ALL),
s AS (SELECT h.prompt_id, kind, id, i.score + h.shared AS score, CAST(ceil(length(i.content) / 4.5) AS BIGINT) AS tokens FROM h JOIN items i USING (kind, id) WHERE kind <> 'error' OR intent = 'fix'),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY prompt_id ORDER BY score DESC, kind, id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, kind, id) AS k FROM s),
z AS (SELECT *, min(CASE WHEN used > 120 AND k > 1 THEN k END) OVER (PARTITION BY prompt_id) AS stop FROM u)
SELECT prompt_id, kind, id, round(score, 6) AS score, tokens FROM z WHERE stop IS NULL OR k < stop"""


@query("m5_memory_merge", MEM)
def m5_memory_merge(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("content"))
    pr = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.when(F.col("item_id") % 2 == 0, "fix").otherwise("general").alias("intent"), F.array_distinct(F.array_append(T.words(F.col("text")), F.lit("error"))).alias("terms"))
    return memory.merged_memory(pr, facts(spark, sf_dir), ev).withColumn("score", F.round("score", 6))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), "event_type")


@query("w11_recent_events", """
WITH r AS (SELECT event_id AS id, user_id AS session_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS k FROM events)
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY (epoch_us(ts) // 1000), id) AS place FROM r WHERE k <= 10""")
def w11_recent_events(spark, sf_dir):
    return memory.recent(events(spark, sf_dir)).select("session_id", "id", "place")


@query("m6_session_context", """
WITH r AS (SELECT event_id, user_id AS session_id, event_type, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS k FROM events)
SELECT session_id, string_agg(event_type, chr(10) ORDER BY t, event_id) AS content FROM r WHERE k <= 10 AND event_type IN ('error', 'view') GROUP BY session_id""")
def m6_session_context(spark, sf_dir):
    r = memory.recent(events(spark, sf_dir)).where("event_type in ('error', 'view')")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "event_type"))), lambda x: x["event_type"])
    return r.groupBy("session_id").agg(F.array_join(lines, "\n").alias("content"))


@query("w12_retention", """
WITH x AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS created_at FROM events), m AS (SELECT max(created_at) AS m FROM x)
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS k FROM x, m WHERE created_at >= m.m - 20 * CAST(86400000 AS BIGINT)) WHERE k <= 5000""")
def w12_retention(spark, sf_dir):
    e = events(spark, sf_dir)
    as_of = e.agg(F.max("created_at")).first()[0] or 0
    return memory.retained(e, F.lit(as_of), 20 * memory.DAY, 5000).select("id")


@query("w15_session_rotation", f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS at FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
n AS (SELECT a.user_id, a.at, min(b.at) AS next FROM e a JOIN e b ON b.user_id = a.user_id AND b.at > a.at + {config.SESSION_MAX_MS} GROUP BY ALL),
s AS (SELECT user_id, 0 AS session, min(e.at) AS begins_at FROM e GROUP BY ALL UNION ALL SELECT s.user_id, s.session + 1, n.next FROM s JOIN n ON n.user_id = s.user_id AND n.at = s.begins_at)
SELECT user_id, CAST(session AS BIGINT) AS session, begins_at FROM s""")
def w15_session_rotation(spark, sf_dir):
    return memory.rotated(events(spark, sf_dir).select(F.col("session_id").alias("user_id"), F.col("created_at").alias("at")))


@query("w14_burst_windows", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS at FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
n AS (SELECT a.user_id, a.at, min(b.at) AS next FROM e a JOIN e b ON b.user_id = a.user_id AND b.at > a.at + 604800000 GROUP BY ALL),
s AS (SELECT user_id, min(e.at) AS begins_at FROM e GROUP BY user_id UNION SELECT s.user_id, n.next FROM s JOIN n ON n.user_id = s.user_id AND n.at = s.begins_at)
SELECT s.user_id, s.begins_at, count(*) AS n FROM s JOIN e ON e.user_id = s.user_id AND e.at BETWEEN s.begins_at AND s.begins_at + 604800000 GROUP BY ALL HAVING count(*) >= 4""")
def w14_burst_windows(spark, sf_dir):
    """Weeks of four events or more, each week counted from its first event."""
    return memory.crowded(events(spark, sf_dir).select(F.col("session_id").alias("user_id"), F.col("created_at").alias("at")), 4, 7 * memory.DAY)


@query("m8_latest_session", "SELECT user_id, arg_max(event_id, (epoch_us(ts) // 1000) * 1000000 + event_id) AS latest, count(*) AS n FROM events GROUP BY user_id")
def m8_latest_session(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("session_id").alias("user_id")).agg(F.max_by("id", F.struct("created_at", "id")).alias("latest"), F.count("*").alias("n"))


@query("a1_chunk_totals", sql("\nSELECT count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks", "chunks"))
def a1_chunk_totals(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query("a2_layer_counts", sql("\nSELECT l.layer, count(c.id) AS n FROM (VALUES ('global'), ('workspace'), ('repo'), ('session')) l(layer) LEFT JOIN (SELECT * FROM chunks WHERE layer <> 'repo') c USING (layer) GROUP BY ALL", "chunks"))
def a2_layer_counts(spark, sf_dir):
    return memory.layer_counts(corpus.chunks(spark, sf_dir).where("layer <> 'repo'"))


@query("a3_feedback_sums", "SELECT doc_id, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END - toxic) AS BIGINT) AS adjustment FROM labels GROUP BY doc_id")
def a3_feedback_sums(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1) - F.col("toxic")).alias("adjustment"))


@query("a4_prompt_analytics", "SELECT event_type AS store, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS tokens, max(user_id) AS max_tokens, round(sum(value), 4) AS latency, max(value) AS max_latency FROM events GROUP BY 1")
def a4_prompt_analytics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("store"), F.col("user_id").alias("tokens"), F.col("value").alias("latency"))
    return memory.usage(e).withColumn("latency", F.round("latency", 4))


@query("a5_freshness", "SELECT event_type, max((epoch_us(ts) // 1000)) AS last_indexed, count(*) AS n FROM events GROUP BY 1")
def a5_freshness(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.max("created_at").alias("last_indexed"), F.count("*").alias("n"))


@query("a6_store_status", sql("\nSELECT (SELECT count(DISTINCT source_file) FROM chunks) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM edges) AS edges", "chunks", "edges"))
def a6_store_status(spark, sf_dir):
    corpus.chunks(spark, sf_dir).createOrReplaceTempView("q_chunks")
    corpus.edges(spark, sf_dir).createOrReplaceTempView("q_edges")
    return spark.sql("SELECT (SELECT count(DISTINCT source_file) FROM q_chunks) AS files, (SELECT count(*) FROM q_chunks) AS chunks, (SELECT count(*) FROM q_edges) AS edges")


@query("a14_distinct_topics", "SELECT DISTINCT lang, source FROM documents")
def a14_distinct_topics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("a16_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a16_p95(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("q_events")
    return spark.sql("SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM q_events GROUP BY event_type")


@query("a17_branch_conflicts", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def a17_branch_conflicts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).where("n > 1")


@query("o8_recent_prompts", "SELECT event_id, event_type FROM events ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC LIMIT 5")
def o8_recent_prompts(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(5).select(F.col("id").alias("event_id"), "event_type")


@query("j17_read_feedback", """
SELECT r.event_id AS retrieved_id, d.event_id AS read_id FROM events r JOIN events d ON r.user_id = d.user_id AND r.event_type = 'view' AND d.event_type = 'click' AND d.ts >= r.ts AND d.ts <= r.ts + INTERVAL 5 MINUTE""")
def j17_read_feedback(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", "event_type")
    return memory.read_feedback_by_time(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


@query("j16_sent_dedup", """
WITH x AS (SELECT event_id, user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_id FROM x WHERE before IS NULL OR ts - before > INTERVAL 15 MINUTE""")
def j16_sent_dedup(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("before", before).where("before is null or ts - before > interval 15 minutes").select("event_id")
