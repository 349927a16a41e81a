"""Scanned scores against scoring every chunk by plain BM25."""

import random

from pyspark.sql import functions as F

from quarrion.operators import scan, search
from quarrion.operators.common import top
from quarrion.plans import rank_queries  # noqa: F401
from quarrion.plans.registry import QUERIES

COLUMNS = {"content": 10.0, "summary": 6.0, "keywords": 20.0}
SCHEMA = "view_id string, id string, content string, summary string, keywords array<string>"


def lists(hits, k):
    h = hits.withColumn("n", F.explode(F.array(*map(F.lit, (0, 1, 2))))).where("n = 0 OR n = 1 AND n_terms = 1 OR n = 2 AND n_terms >= 2")
    h = h.withColumn("value", F.round(F.when(F.col("n") == 2, F.col("score") * F.col("n_terms")).otherwise(F.col("score")), 9))
    return sorted((r.prompt_id, r.n, r.rank, r.id, round(r.score, 6), r.n_terms) for r in top(h, ["prompt_id", "n"], [F.desc("value"), "id"], k, "rank").collect())


def test_leaders_hold_the_best(spark, monkeypatch):
    """Lists cut from leaders() equal those of all hits; many equal texts, a view without hits, null views and texts; blocks of few chunks."""
    r = random.Random(5)
    words = ["common"] * 20 + [f"word{k}" for k in range(30)] + [f"rare{k}" for k in range(60)] + ["runs", "running", "Été"]
    rows = []
    for k in range(500):
        text = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 12, 60])))
        rows.append((r.choice("ab"), f"c{k:04d}", text, text[:20], [r.choice(words) for _ in range(r.randint(0, 3))]))
    rows += [("a", f"same{r.random()}", "twin word1 rare0", "", []) for _ in range(400)]
    rows += [("c", "alone", "nothing here", "", []), (None, "no view", "common word1", "", []), ("b", "null", None, None, None)]
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = [(p, w) for p in range(20) for w in r.sample(["common", "run", "ete", "twin", "word1", "absent", *words[20:]], r.randint(1, 10))] + [(50, "twin"), (50, "word1"), (51, "twin"), (60, "absent")]
    terms = spark.createDataFrame(asked, "prompt_id long, term string")
    plain = search.bm25(chunks, terms, COLUMNS)
    stems = search.folded(terms, "prompt_id")
    for cells in (1_000_000, 900):
        monkeypatch.setattr(scan, "CELLS", cells)
        found = scan.leaders(chunks, stems, 4, COLUMNS)
        assert lists(found, 4) == lists(plain, 4)
    assert found.where("prompt_id = 51").count() < 400
    monkeypatch.setattr(scan, "BROADCAST_ROWS", 5)
    assert scan.leaders(chunks, stems, 4, COLUMNS) is None


def test_fusion_writes_no_index(spark, monkeypatch):
    """A batch of prompts is scored in passes over the texts, so that a query doesn't pay for an index of all words."""
    from quarrion.plans import corpus

    monkeypatch.setattr(corpus, "indexes", lambda *a: 1 / 0)
    assert QUERIES["a8_rrf"](spark, "/root/testdata/sf0.001").count() > 0


def test_coverage_by_scan(spark, monkeypatch):
    """covered() against term_coverage(): parts of words, accents, texts without words; blocks of few chunks. Nothing is shuffled."""
    r = random.Random(3)
    words = ["common", "com", "mon", "on", "été", "x", "zebra", "commonly", "uncommon", "absent0"]
    rows = [(f"c{k}", " ".join(r.choice(words[:-1]) for _ in range(r.choice([0, 1, 3, 9])))) for k in range(200)] + [("null", None), ("odd", "--, Été!")]
    chunks = spark.createDataFrame(rows, "id string, content string")
    terms = spark.createDataFrame([(p, w) for p in range(12) for w in r.sample(words, r.randint(1, 6))] + [(99, "absent0")], "prompt_id long, term string")
    rows_of = lambda df: sorted((x.prompt_id, x.id, round(x.coverage, 9)) for x in df.collect())
    want = rows_of(search.term_coverage(chunks, terms))
    assert want and rows_of(scan.covered(chunks, terms, 0.0)) == want
    monkeypatch.setattr(scan, "CELLS", 50)
    assert rows_of(scan.covered(chunks, terms, 0.5)) == [x for x in want if x[2] >= 0.5]
    plan = QUERIES["a12_term_coverage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_matches_shuffle_no_postings(spark):
    """All terms and prefixes are matched where the chunk is; counts by term shuffle no chunk ids."""
    plan = lambda q: QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("x3_match_all") and "Exchange" not in plan("x3_match_prefix")
    assert "md5" not in plan("x1_postings")


def test_phrases_by_scan(spark, monkeypatch):
    """phrases() against looking for each phrase in each text; null views and texts, phrases of one word, without words, of absent words. Recall builds no index."""
    from quarrion.plans import corpus, scope_queries  # noqa: F401

    r = random.Random(4)
    some = ["a", "b", "été", "c", "d"]
    rows = [("v" if k % 3 else None, f"c{k}", " ".join(r.choice(some) for _ in range(r.choice([0, 1, 3, 9])))) for k in range(300)] + [("v", "null", None), ("v", "odd", "A,b--Été")]
    chunks = spark.createDataFrame(rows, "view_id string, id string, content string")
    asked = [(p, [r.choice(some) for _ in range(p % 5)]) for p in range(20)] + [(50, ["absent", "a"])]
    found = scan.phrases(chunks, spark.createDataFrame(asked, "prompt_id long, words array<string>"))
    text = lambda c: " " + (c or "").lower().replace(",", " ").replace("--", " ") + " "
    want = sorted((p, i) for p, ws in asked if ws for _, i, c in rows if f" {' '.join(ws)} " in text(c))
    assert want and sorted((x.prompt_id, x.id) for x in found.collect()) == want
    monkeypatch.setattr(corpus, "indexes", lambda *a: 1 / 0)
    assert QUERIES["a15_recall"](spark, "/root/testdata/sf0.001").count() > 0
