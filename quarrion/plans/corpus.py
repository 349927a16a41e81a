"""The supplied tables seen as the engine's own: chunks, prompts, edges, facts, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions import text as T
from quarrion.operators import retrieve
from quarrion.operators.common import fresh_folder
from quarrion.plans.registry import table

LAYERS = ("global", "workspace", "repo", "session")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a line of a document."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", "source", F.col("lang").alias("view_id"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.md5(F.concat(path, F.lit(":"), F.col("line").cast("string"))).alias("id"),
        path.alias("source_file"),
        F.get(F.array(*map(F.lit, LAYERS)), (F.col("doc_id") % 4).cast("int")).alias("layer"),
        "view_id",
        "doc_id",
        F.col("line").cast("long").alias("line"),
        "content",
        F.sha2("content", 256).alias("hash"),
        (F.col("doc_id") % 10 + 1).alias("importance"),
        F.ceil(F.length("content") / 4.5).alias("token_count"),
    )


def fielded(c: DataFrame) -> DataFrame:
    """chunks with the columns that are searched: section_title, summary and keywords beside content."""
    long_ = F.filter(T.words(F.col("content")), lambda x: F.length(x) >= 10)
    return c.withColumns({"section_title": F.split_part("source_file", F.lit("/"), F.lit(1)), "summary": F.substring("content", 1, 60), "keywords": long_})


_INDEXES: dict[tuple, retrieve.Indexes] = {}


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What tells whether a table's files have changed: their names, sizes and times."""
    sc = spark.sparkContext
    out = []
    for f in sorted(table(spark, sf_dir, name).inputFiles()):
        at = sc._jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((f, status.getLen(), status.getModificationTime()))
    return sc.applicationId, *out


def symbols(c: DataFrame) -> DataFrame:
    """fielded chunks with names: the first long word is the symbol, the first line a class, other lines members of its file."""
    symbol = F.regexp_extract("content", "[a-z]{6,}", 0)
    kind = F.when(F.col("line") == 0, "class").otherwise("function")
    return c.withColumns({"symbol_name": F.when(symbol != "", symbol), "symbol_kind": kind, "parent_symbol": F.when(F.col("line") > 0, F.regexp_extract("source_file", "([0-9]+)", 1)), "file_stem": T.file_stem(F.col("source_file")), "updated_at": F.lit(0).cast("long")})


def indexes(spark: SparkSession, sf_dir: str) -> retrieve.Indexes:
    """The stored indexes of the chunks, written once a session and state of the documents."""
    key = _state(spark, sf_dir, "documents")
    if key not in _INDEXES:
        _INDEXES[key] = retrieve.indexes(symbols(fielded(chunks(spark, sf_dir))), fresh_folder(spark, "indexes"))
    return _INDEXES[key]


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))


def prompt_terms(p: DataFrame, n: int = 15) -> DataFrame:
    """(prompt_id, term): the first n distinct words that aren't stopwords."""
    w = F.slice(F.array_distinct(F.filter(T.words(F.col("prompt")), lambda x: ~x.isin(*T.STOPWORDS))), 1, n)
    return p.select("prompt_id", F.explode(w).alias("term"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys of the star schema as typed, weighted edges between entities."""
    return repeated_edges(spark, sf_dir).distinct()


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(), each as often as the tables have it, for what takes repeated ones as one."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("source"), F.concat(F.lit("customer:"), "o_custkey").alias("target"), F.lit("placed_by").alias("type"), F.lit(2.0).alias("weight"))
    li = table(spark, sf_dir, "lineitem")
    s = li.select(F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.concat(F.lit("supplier:"), "l_suppkey").alias("target"), F.lit("ships_from").alias("type"), F.lit(0.8).alias("weight"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("source"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"), F.lit("lives_in").alias("type"), F.lit(1.0).alias("weight"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("source"), F.concat(F.lit("region:"), "n_regionkey").alias("target"), F.lit("part_of").alias("type"), F.lit(0.4).alias("weight"))
    return o.unionByName(s).unionByName(c).unionByName(n)


#: The same, as common table expressions for the oracle.
SQL = {
    "chunks": """chunks AS (
  SELECT md5(source || '/' || doc_id || '.txt:' || line) AS id, source || '/' || doc_id || '.txt' AS source_file,
         ['global','workspace','repo','session'][doc_id % 4 + 1] AS layer, lang AS view_id, doc_id, line, content,
         sha256(content) AS hash, doc_id % 10 + 1 AS importance, CAST(ceil(length(content) / 4.5) AS BIGINT) AS token_count
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content,
               unnest(range(len(string_split(text, chr(10))))) AS line FROM documents))""",
    "prompts": "prompts AS (SELECT item_id AS prompt_id, text AS prompt FROM benchmark)",
    "edges": """edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'placed_by' AS type, CAST(2.0 AS DOUBLE) AS weight FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'ships_from', 0.8 FROM lineitem
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in', 1.0 FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', 0.4 FROM nation))""",
}
STOP = "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"
SQL["words"] = r"""words AS (
  SELECT id, view_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM chunks)"""
SQL["prompt_terms"] = rf"""prompt_terms AS (
  SELECT prompt_id, unnest(list_transform(list_slice(list_filter(list_transform(u, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(u, s.x) = s.i), 1, 15), lambda s: s.x)) AS term
  FROM (SELECT prompt_id, list_filter(regexp_split_to_array(lower(prompt), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND NOT list_contains({STOP}, x)) AS u FROM prompts))"""


def sql(body: str, *names: str) -> str:
    """A statement with the named table expressions before it."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + body
