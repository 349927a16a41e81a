import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion.llm import additive, queries

SF = "/root/testdata/sf0.01"


def test_features_plainly(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " \n\t", "ABC def. Ghi!\nABC def. Ghi!\n\nx", "é É ß", "a a a a b", "%%% $$$ word### 12"] + ["".join(r.choice("aB c.\n#é1!") for _ in range(r.randint(0, 200))) for _ in range(40)] + ["long word " * 5000]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(additive, "CHUNK", chunk)
        got = additive.features(texts)
        for t, row in zip(texts, got, strict=True):
            t = (t or "").encode()
            f = dict(zip(additive.NAMES, row, strict=True))
            words, n = t.split(), max(len(t), 1)
            letters = [chr(c) for c in t if chr(c).isascii() and chr(c).isalpha()]
            lines = [x for x in t.split(b"\n") if x.strip()]
            assert f["chars"] == pytest.approx(math.log1p(len(t))) and f["words"] == pytest.approx(math.log1p(len(words)))
            assert f["upper"] == pytest.approx(sum(c.isupper() for c in letters) / max(len(letters), 1))
            assert f["digits"] == pytest.approx(sum(48 <= c <= 57 for c in t) / n) and f["calls"] == pytest.approx((t.count(b"!") + t.count(b"?")) / n)
            assert f["symbols"] == pytest.approx(sum(chr(c) in "#*$%&|<>@^~=+_\\/{}[]" for c in t) / n)
            assert f["other_bytes"] == pytest.approx(sum(c > 127 for c in t) / n) and f["line_ends"] == pytest.approx(t.count(b"\n") / n)
            w = max(len(words), 1)
            assert f["distinct_words"] == pytest.approx(len(set(words)) / w) and f["repeats"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / w)
            assert f["short_words"] == pytest.approx(sum(len(x) <= 3 for x in words) / w) and f["word_length"] == pytest.approx(sum(map(len, words)) / w)
            assert f["repeated_lines"] == pytest.approx(1 - len(set(lines)) / len(lines) if words else 0)


def gain(g, h):
    return g * g / (h + additive.RIDGE)


def test_tree_and_quadrants_by_trying_all():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 9):
        for _ in range(20):
            g, h = r.normal(size=n), r.uniform(0.5, 4, n)

            def best(a, b):
                found = [(gain(g[a:k].sum(), h[a:k].sum()) + gain(g[k:b].sum(), h[k:b].sum()) - gain(g[a:b].sum(), h[a:b].sum()), -k) for k in range(a + 1, b) if h[a:k].sum() >= additive.LEAST and h[k:b].sum() >= additive.LEAST]
                return -max(found)[1] if found and max(found)[0] > 0 else a

            top = best(0, n)
            edges = sorted({0, top, n, best(0, top), best(top, n)})
            want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + additive.RIDGE)) for a, b in zip(edges, edges[1:], strict=False)])
            assert np.allclose(additive.tree(g, h), want)
    g, h = r.normal(size=(5, 6)), r.uniform(0.1, 2, (5, 6))
    tries = []
    for i in range(1, 5):
        for j in range(1, 6):
            four = [(g[a, b].sum(), h[a, b].sum()) for a in (slice(i), slice(i, 5)) for b in (slice(j), slice(j, 6))]
            tries.append((sum(gain(*x) for x in four) - gain(g.sum(), h.sum()), i, j, [x / (y + additive.RIDGE) for x, y in four]))
    got, table = additive.quadrants(g, h)
    top, i, j, values = max(tries)
    assert got == pytest.approx(top) and np.allclose([table[0, 0], table[0, -1], table[-1, 0], table[-1, -1]], values)
    assert np.allclose(table[:i, :j], values[0]) and np.allclose(table[i:, j:], values[3])


def test_pairs_are_learned():
    """An exclusive or of two features, which no sum of single features can tell; scores are sums of entries."""
    r = np.random.default_rng(3)
    x = r.uniform(size=(2000, len(additive.NAMES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    m = additive.train(x, y)
    assert (2, 7) in [(i, j) for i, j, _ in m.pairs]
    fresh = r.uniform(size=(500, len(additive.NAMES)))
    z = m.total(fresh)
    assert (((fresh[:, 2] > 0.5) ^ (fresh[:, 7] > 0.5)) == (z > 0)).mean() > 0.85
    for row, got in list(zip(fresh, z, strict=True))[:50]:
        b = [sum(e <= v for e in edges) for edges, v in zip(m.edges, row, strict=True)]
        c = [k * additive.COARSE // (len(e) + 1) for k, e in zip(b, m.edges, strict=True)]
        assert got == pytest.approx(m.intercept + sum(t[k] for t, k in zip(m.tables, b, strict=True)) + sum(t[c[i], c[j]] for i, j, t in m.pairs))
    assert len(m.pairs) <= additive.PAIRS and all(i < j for i, j, _ in m.pairs) and len(list(combinations(range(15), 2))) == 105


@pytest.mark.parametrize(("sf", "bad", "good"), [("sf0.01", 0.8, 0.95), ("sf0.1", 0.95, 0.98)])
def test_held_out_accuracy(spark, sf, bad, good):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").toPandas()
    got = queries.QUERIES["op11_additive_quality"](spark, f"/root/testdata/{sf}").toPandas()
    assert len(got) == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert ((m.score >= 0.3).astype(int) == m.predicted).all()
    print(sf, len(m), (m[m.quality == 0].predicted == 0).mean(), (m[m.quality == 1].predicted == 1).mean())
    assert (m[m.quality == 0].predicted == 0).mean() >= bad and (m[m.quality == 1].predicted == 1).mean() >= good


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    odd = spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "x " * 200_000), (-4, "twice"), (-4, "twice")], "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (-1, None, 0), (-4, 0, 1), (-4, 1, 1)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)
    df = docs.unionByName(odd).withColumns({"score": F.lit("s"), "predicted": F.lit(None), "quality": F.lit(1)})
    got = additive.scored(df, labels).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got) and by[-1] == by[-2]
    assert sorted(r.doc_id for r in got if r.doc_id is not None and r.doc_id < 0) == [-4, -4, -3, -2, -1]
    assert not [r.held_out for r in got if r.doc_id is None][0]
    assert additive.scored(df.limit(0), labels).collect() == []
    assert {r.score for r in additive.scored(df, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in additive.scored(df, labels.where("quality = 1")).collect()} <= {0.0, 1.0}
