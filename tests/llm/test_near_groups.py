"""The near-duplicate stage on groups of near copies: found by fingerprints first, and by a number of trials that grows with the group."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from quarrion.llm import similar, simhash
from test_similar import SF, brute


def copies(n, seed):
    """n near copies of a text of 104 words, most with few edits of their own, a fifth with so many that they are alone."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(104)]
    rows = []
    for k in range(n):
        text = list(base)
        for j in range(4 if k % 5 == 0 else k % 2):
            text[r.randrange(len(text))] = f"x{k}_{j}"
        rows.append((k, " ".join(text)))
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def tried(spark, monkeypatch, rows):
    """Rows that stay, and the pairs that were compared."""
    pairs, alike = [], similar._alike
    monkeypatch.setattr(similar, "_alike", lambda p, nodes: pairs.append(p.count()) or alike(p, nodes))
    got = sorted(r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())
    monkeypatch.setattr(similar, "_alike", alike)
    return got, sum(pairs)


def test_trials_grow_with_the_group(spark, monkeypatch):
    rows = copies(240, 1)
    got, n = tried(spark, monkeypatch, rows)
    assert got == brute(rows)
    assert n < 8 * len(rows)


def test_pair_that_meets_late_is_not_tried(spark):
    df = spark.createDataFrame([(90, 9, 90, 9), (90, 11, 90, 9), (90, 15, 90, 15), (100, 0, 80, 0)], "n int, at int, m int, other int")
    assert [r[0] for r in df.select(similar._possible(*(F.col(c) for c in df.columns))).collect()] == [True, False, False, True]


def test_fingerprints_and_trees_find_pairs_first(spark, monkeypatch):
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *a: seen.append((nodes, links(nodes, *a))) or seen[-1][1])
    text = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:-1])), (3, " ".join(text[::-1]))]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
    nodes, found = seen[0]
    assert nodes.count() == 3 and found.distinct().count() == 1
