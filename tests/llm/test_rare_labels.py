"""Languages with few of the labelled rows are learned like others; too many languages are refused."""

import random

import pytest

from quarrion.llm import langid


def texts(letters, n, r):
    return [" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(60)) for _ in range(n)]


def test_rare_language_is_learned(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, t, "big") for i, t in enumerate(texts("abcde", 6000, r))] + [(10_000 + i, t, "rare") for i, t in enumerate(texts("vwxyz", 8, r))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(d).langs == ["big", "rare"]
    got = {x.doc_id: x.lang_pred for x in langid.identified(d).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    monkeypatch.setattr(langid, "LANGS", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(d)
