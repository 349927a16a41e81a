"""Verified facts and links as part of a retrieval, topics, and the view of one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions import text as T
from quarrion.operators import graph, scope
from quarrion.operators.common import small, top


def remembered(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts with new ones, keyed by scope and text; a fact from code needs evidence, one from a user doesn't."""
    ok = new.where((F.col("provenance") != "code") | (F.size(F.coalesce("evidence", F.array().cast("array<struct<view_id:string>>"))) > 0))
    key = ["scope", "scope_id", "fact"]
    return facts.join(ok, key, "left_anti").unionByName(ok)


def fact_hits(facts: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """(prompt_id, id, overlap): the facts(id, fact) that hold most of a prompt's terms(prompt_id, term), as parts of their text."""
    words = facts.select("id", F.explode(F.array_distinct(T.words(F.col("fact")))).alias("term"))
    hits = words.join(small(terms.distinct()), "term").groupBy("prompt_id", "id").agg(F.count("*").alias("overlap"))
    return top(hits, ["prompt_id"], [F.desc("overlap"), "id"], n)


def with_facts(hits: DataFrame, found: DataFrame) -> DataFrame:
    """hits(prompt_id, id, score) and the facts found, at 0.8 of the prompt's best score."""
    best = hits.groupBy("prompt_id").agg(F.max("score").alias("m"))
    return hits.unionByName(found.join(best, "prompt_id").select("prompt_id", F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("id"), (F.col("m") * 0.8).alias("score")))


def with_links(hits: DataFrame, links: DataFrame, permitted: list[str], hops: int = 2, limit: int = 12, lead: int = 10) -> DataFrame:
    """hits and what verified links reach from the ten best, at 0.6 of the best score a hop."""
    refs = top(hits, ["prompt_id"], [F.desc("score"), "id"], lead).select("prompt_id", F.col("id").alias("ref"))
    near = graph.link_frontier(links, refs, permitted, hops, limit)
    best = hits.groupBy("prompt_id").agg(F.max("score").alias("m"))
    new = near.join(best, "prompt_id").select("prompt_id", F.col("ref").alias("id"), (F.col("m") * F.col("factor")).alias("score"))
    new = new.groupBy("prompt_id", "id").agg(F.max("score").alias("score"))
    return hits.unionByName(new.join(hits, ["prompt_id", "id"], "left_anti"))


def neighbours_with_chunks(edges: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours of nodes(node) with the file of the chunk that an edge comes from, where it's still there."""
    e = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "source_chunk_id").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "source_chunk_id"))
    near = e.join(small(nodes.select("node").distinct()), "node")
    return near.join(chunks.select(F.col("id").alias("source_chunk_id"), "source_file"), "source_chunk_id", "left")


def symbol_view(chunks: DataFrame, edges: DataFrame, names: DataFrame, most_edges: int = 20, lines: int = 150) -> DataFrame:
    """(name, part, text): the first chunk of a symbol(name) in full up to 150 lines, its other places, and its heaviest edges."""
    n = names.select("name", F.lower("name").alias("_n"))
    c = chunks.withColumn("_n", F.lower("symbol_name")).join(small(n), "_n")
    first = top(c, ["name"], ["id"], 1, "k")
    body = first.select("name", F.lit("body").alias("part"), F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n").alias("text"))
    rest = c.join(first.select("name", "id"), ["name", "id"], "left_anti").select("name", F.lit("place").alias("part"), F.concat_ws(":", "source_file", F.col("start_line").cast("string")).alias("text"))
    e = graph.both_ways(edges).withColumn("_n", F.lower("node")).join(small(n), "_n")
    near = top(e, ["name"], [F.desc("weight"), "neighbour", "direction"], most_edges).select("name", F.lit("edge").alias("part"), F.concat_ws(" ", "direction", "type", "neighbour").alias("text"))
    return body.unionByName(rest).unionByName(near)


def topics(chunks: DataFrame) -> DataFrame:
    """Titles of markdown sections by file."""
    return chunks.where("file_type = 'markdown' and section_title is not null").select("source_file", "section_title").distinct()


def call_terms(hits: DataFrame, least: int = 2) -> DataFrame:
    """(prompt_id, term, n): names that a prompt's hits call at least twice; they count as signals when packing."""
    calls = F.explode(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]{3,})\("), F.lit(1)))
    n = hits.select("prompt_id", calls.alias("term")).groupBy("prompt_id", "term").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least)


def visible(facts: DataFrame, views: list[str], projects: list[str], group: str | None = None) -> DataFrame:
    return scope.visible_facts(facts, views, projects, group)
