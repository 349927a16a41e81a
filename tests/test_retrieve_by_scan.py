"""Retrieval in passes over the texts against the stored index."""

from pyspark.sql import functions as F

from quarrion.operators import graph, names, retrieve
from quarrion.plans import corpus, source_queries  # noqa: F401
from quarrion.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_lists_equal_those_of_the_index(spark):
    """All strategies' lists, also of quoted words, of prompts with all their few words in a text, and of names asked in upper and lower case."""
    c = corpus.symbols(corpus.fielded(corpus.chunks(spark, SF)))
    lines = [r.content for r in c.where("length(content) > 40").orderBy("id").select("content").limit(6).collect()]
    asked = [(k, f'Fix "{" ".join(x.split()[:3])}" in {x.split()[4].title()} and {x.split()[4]}') for k, x in enumerate(lines)] + [(50 + k, " ".join(x.split()[2:5])) for k, x in enumerate(lines)] + [(90, "zzzz qqqq"), (91, "txt src")]
    i = retrieve.intents(corpus.prompts(spark, SF).unionByName(spark.createDataFrame(asked, "prompt_id long, prompt string").withColumn("prompt_id", F.col("prompt_id") + 100_000))).cache()
    rows = lambda **a: sorted((r.prompt_id, r.strategy, r.id, r.weight, round(r.score, 6)) for r in retrieve.candidate_lists(c, i, **a).collect())
    got = rows(long_words={"keywords": ("content", 10)})
    assert got == rows(index=corpus.indexes(spark, SF))
    assert {"fts-or", "fts-and", "quoted-term", "file-sibling", "identifier-symbol", "section-title"} <= {r[1] for r in got} and any(r[1].startswith("fts-term:") for r in got)


def test_query_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(corpus, "indexes", lambda *a: 1 / 0)
    monkeypatch.setattr(retrieve.fulltext, "build", lambda *a: 1 / 0)
    assert QUERIES["r18_retrieve"](spark, SF).count() > 0


def test_grams_at_each_probe(spark):
    rows = spark.createDataFrame([("alpha",), ("alphabet",), ("beta",), ("ab",), (None,), ("beta",)], "name string")
    terms = spark.createDataFrame([(1, "alpha"), (2, "bet"), (3, "be"), (4, "none")], "k int, term string")
    for prefix in (False, True):
        found = [sorted(map(tuple, x.probed(terms, prefix).select("k", "term", "name").collect())) for x in (names.index(rows), names.passing(rows))]
        assert found[0] == found[1] and found[0]


def test_near_edges_are_enough(spark):
    """A hop over the edges of its own nodes reaches what one over all edges does; hubs and repeated edges included."""
    e, some = corpus.repeated_edges(spark, SF), spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 40 = 0")
    seeds = some.select(F.col("o_orderkey").alias("prompt_id"), F.concat(F.lit("order:"), "o_orderkey").alias("node")).unionByName(spark.createDataFrame([(1, "nation:3"), (1, "nowhere")], "prompt_id long, node string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(graph.expanded_near(e, seeds, 2, 50))
    assert got == rows(graph.expanded(e, seeds, 2, 50)) and {r[2] for r in got} == {1, 2}
