"""The near-duplicate stage against all pairs of 5-word shingle sets."""

import random

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Smallest id of each group linked by a Jaccard similarity of at least 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted({find(i) for i in ids})


def test_stage_drops_all_at_08(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.near_duplicates(spark, d, SF)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == brute([(r.doc_id, r.text) for r in d.collect()])


def test_chains_and_edges_of_the_limit(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for n in (6, 9, 14, 49, 104):  # from 2 shingles to 100; copies that lose words at the end, and chains of edits
        base = r.sample(words, n)
        for k in range(8):
            rows.append(base[: n - k] if k < n else base)
        text = list(base)
        for k in range(12):
            text[(7 * k) % n] = f"x{n}_{k}"
            rows.append(list(text))
    passage = r.sample(words, 40)
    rows += [passage + r.sample(words, 60) for _ in range(30)] + [[], ["a"], ["A"], ["a", "b"]]
    order = list(range(len(rows)))
    r.shuffle(order)
    rows = [(i, " ".join(t)) for i, t in zip(order, rows, strict=True)] + [(9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in P.near_duplicates(spark, df, SF).collect()) == brute(rows)
