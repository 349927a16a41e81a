"""Each stage on its own input against plain computations, and the whole run."""

import zlib
from collections import Counter

import numpy as np
from test_similar import brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quarrion.llm import common as C
from quarrion.llm import divergence, mixing, toxicity
from quarrion.llm.encode import default_path

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "toxicity", "simhash near-dedup", "mixing", "packing"]
    inputs = [docs]
    for _, f in P.STAGES[:-1]:
        out = C.cut(f(spark, inputs[-1], SF), "test-stage")
        assert out.columns == docs.columns
        inputs.append(out)
    quality, toxic, dedup, mixed = inputs[1:]
    keep = {r.doc_id for r in divergence.scores(docs).collect() if r.kept}
    assert Counter(rows(quality)) == Counter(r for r in rows(docs) if r[0] in keep)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.scored(quality, labels).collect()}
    assert Counter(rows(toxic)) == Counter(r for r in rows(quality) if scored[r[0]] == 0)
    firsts = set(brute([(r.doc_id, r.text) for r in toxic.collect()]))
    assert Counter(rows(dedup)) == Counter(r for r in rows(toxic) if r[0] in firsts)
    copies = {r.doc_id: r.copies for r in mixing.mix(dedup).collect()}
    assert Counter(r[0] for r in rows(mixed)) == Counter({i: n for i, n in copies.items() if n})
    t = Tokenizer.from_file(default_path())
    want, ids = Counter(), {}
    for r in mixed.collect():
        ids[r.doc_id] = np.array(t.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes()
        want[r.doc_id] += 1
    got = Counter()
    for r in P.pack(spark, mixed, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
        for k in range(r.start, r.start + r.length):
            got[r.doc_id, k] += 1
    assert got == Counter({(i, k): n for i, n in want.items() for k in range(len(ids[i]) // 4)})


def test_stages_take_odd_tables(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, size int, kept boolean"
    odd = [(1, None, None, None, None, 1, True), (None, "a b c", "en", "s", 5, 1, None), (2, "", "en", "s", 0, 1, True), (3, "word " * 3000, "en", None, 1, 1, True), (3, "word " * 3000, "en", None, 1, 1, True)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, shape)
        for _, f in P.STAGES[:-1]:
            assert f(spark, docs, SF).columns == docs.columns and f(spark, docs, SF).count() <= 3 * len(data)
        assert P.pack(spark, docs, SF).count() >= len(data)


#: Names that the operators use inside, or have used.
NAMES = "h fp rep row n n_words kept size copies target mean lam more docs source_size lo hi component_id fingerprint score predicted held_out _m _m_ref _m_text _h _n _ref _lang _kept _row _words _text _size _key _u _rate _base _bucket _copies _copy _piece _pieces _id _i part i v k m u a b sketch set s at g start length sequence_id offset".split()


def test_stages_take_any_names(spark):
    """A column of each name, in one table, comes back as it was."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    some = docs.select("*", *(F.concat(F.lit(x), F.col("doc_id")).alias(x) for x in NAMES))
    some = some.unionByName(some.limit(3))
    for name, f in P.STAGES[:-1]:
        out = f(spark, some, SF)
        assert out.columns == some.columns, name
        got = out.collect()
        assert got and all(r[x] == f"{x}{r.doc_id}" for r in got for x in NAMES), name
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in f(spark, some.select(*docs.columns), SF).collect()), name
    assert P.pack(spark, some, SF).count() >= some.count()


def test_run(spark):
    df = P.run(spark, SF)
    assert P.ORACLE_SQL is None and df.count() > 0 and {"doc_id", "start", "length", "sequence_id"} <= set(df.columns)
