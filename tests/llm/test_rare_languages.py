"""Languages of a small share beside a huge one."""

import random

import pytest

from quarrion.llm import divergence

SIZES = {"big": 7500, "b": 8, "c": 8, "tiny": 1, None: 8}


def corpus(spark):
    """SIZES documents of 300 words a language, each with its own common words."""
    r, rows = random.Random(6), []
    for lang, n in SIZES.items():
        own = [f"{lang or 'none'}{i}" for i in range(40)]
        for _ in range(n):
            rows.append((len(rows), " ".join(r.choice(own) for _ in range(300)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("langs", [500, 2])
def test_own_references(spark, monkeypatch, langs):
    """Each language of ENOUGH words has its own, broadcast or joined; clean documents stay; too few words: not judged."""
    d = corpus(spark)
    with monkeypatch.context() as m:
        m.setattr(divergence, "LANGS", langs)
        refs = {r[0] for r in divergence.word_references(d).select("lang").collect()}
        got = divergence.scores(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert refs == {"=big", "=b", "=c", "~"}
    assert len(got) == sum(SIZES.values())
    assert all(r.kept for r in got)
    assert all((r.word_distance is None) == (r.lang == "tiny") for r in got)
