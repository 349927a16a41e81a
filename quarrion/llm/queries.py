"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm import additive, binpack, bitplane, changepoints, divergence, langid, mixing, packing, phrases, simhash, toxicity, vafile, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_bitplane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_files(table(spark, sf_dir, "documents"))


@query
def op1_warc_zip_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op4_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.shards(table(spark, sf_dir, "documents"))


@query
def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.scores(table(spark, sf_dir, "documents"))


@query
def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op3_va_file_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op8_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


@query
def op9_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.segments(table(spark, sf_dir, "sale_lines"))


ORACLE["op12_change_points"] = """
WITH RECURSIVE taken AS (
  SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS BIGINT) AS q
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), span AS (
  SELECT vendor_id, unnest(range(min(day), max(day) + 1)) AS day FROM taken GROUP BY vendor_id
), series AS (
  SELECT s.vendor_id, list(coalesce(t.q, 0) ORDER BY s.day) AS x, min(s.day) AS first
  FROM span s LEFT JOIN taken t ON s.vendor_id IS NOT DISTINCT FROM t.vendor_id AND s.day = t.day GROUP BY s.vendor_id
), base AS (
  SELECT vendor_id, first, x, len(x) AS n, least(14, len(x)) AS least_days,
    list_transform(range(0, len(x) + 1), lambda e: CAST(coalesce(list_sum(x[1:e]), 0) AS HUGEINT)) AS p,
    list_transform(range(0, len(x) + 1), lambda e: CAST(coalesce(list_sum(list_transform(x[1:e], lambda y: y * y)), 0) AS HUGEINT)) AS r
  FROM series
), step AS (
  SELECT vendor_id, 0 AS e, CAST([{'c': 0, 's': 0, 'k': 0}] AS STRUCT(c BIGINT, s BIGINT, k BIGINT)[]) AS best FROM base
  UNION ALL
  SELECT t.vendor_id, t.e + 1, list_append(t.best, list_min(list_transform(
    list_filter(range(0, t.e + 2 - b.least_days), lambda k: k = 0 OR k >= b.least_days),
    lambda k: {
      'c': CAST(t.best[k + 1].c + CASE WHEN k = 0 THEN 0 ELSE 40000 END
        + (t.e + 1 - k) * floor(1000 * ln(CAST(1 + ((t.e + 1 - k) * (b.r[t.e + 2] - b.r[k + 1]) - (b.p[t.e + 2] - b.p[k + 1]) * (b.p[t.e + 2] - b.p[k + 1])) // ((t.e + 1 - k) * (t.e + 1 - k)) AS DOUBLE))) AS BIGINT),
      's': CAST(t.best[k + 1].s + 1 AS BIGINT), 'k': CAST(k AS BIGINT)})))
  FROM step t JOIN base b ON t.vendor_id IS NOT DISTINCT FROM b.vendor_id WHERE t.e < b.n
), found AS (
  SELECT b.vendor_id, b.first, b.p, b.r, t.best, b.n, t.best[b.n + 1].s AS n_segments, t.best[b.n + 1].c AS best_cost
  FROM step t JOIN base b ON t.vendor_id IS NOT DISTINCT FROM b.vendor_id AND t.e = b.n
), back AS (
  SELECT *, n AS stop, best[n + 1].k AS start, n_segments AS segment_no FROM found
  UNION ALL
  SELECT * REPLACE (start AS stop, best[start + 1].k AS start, segment_no - 1 AS segment_no) FROM back WHERE start > 0
), cut AS (
  SELECT *, stop - start AS m, p[stop + 1] - p[start + 1] AS total, r[stop + 1] - r[start + 1] AS squares FROM back
), valued AS (
  SELECT *, 1 + (m * squares - total * total) // (m * m) AS spread FROM cut
)
SELECT vendor_id, CAST(segment_no AS INTEGER) AS segment_no, first + start AS first_day, CAST(m AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total,
  CAST(spread AS BIGINT) AS spread, CAST(m * floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost, n_segments, best_cost
FROM valued
"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, unnest([1, 2, 3, 4]) t(m) WHERE len(w) >= m
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT *, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, min({'score': 2000000::HUGEINT * c.a // (l.a + r.a), 'k': c.k, 'l': l.a, 'r': r.a}) AS s
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
  GROUP BY ALL
), spans AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda b: list_transform(range(1, m - b + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + b - 1], ' '))))) AS phrase
  FROM f WHERE m > 2
), outer_ AS (
  SELECT lang, phrase, max(a) AS a FROM spans GROUP BY ALL
), ranked AS (
  SELECT s.lang, s.phrase, s.a, s.s, row_number() OVER (PARTITION BY s.lang ORDER BY s.s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN outer_ o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * s.a
)
SELECT r.lang, r.rank, r.phrase, r.a, CAST(r.s.l AS BIGINT) AS l, CAST(r.s.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(r.s.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
