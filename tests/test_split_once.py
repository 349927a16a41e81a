"""What the scan takes from Arrow against the JVM's words and the plain stemmer."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quarrion.functions import text as T
from quarrion.functions.stem import ENDS, heads, porter
from quarrion.operators import scan, search
from quarrion.plans.registry import QUERIES


def test_words_of_every_character(spark):
    """split() gives T.words() around each character there is; characters that the JVM's Unicode lacks part words."""
    t = spark.range(0x110000).where("id < 55296 OR id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    t = t.select(F.concat(F.lit("Xa"), "c", F.lit("b1 "), "c").alias("t")).select(T.splittable(F.col("t")).alias("s"), T.words(F.col("t")).alias("w")).toArrow().combine_chunks()
    row, word = scan.split(t["s"].combine_chunks())
    assert (row.tolist(), word.to_pylist()) == tuple(map(list, zip(*((i, x) for i, w in enumerate(t["w"].to_pylist()) for x in w), strict=True)))
    words = word.unique()
    assert scan.unaccented_array(words).to_pylist() == [search.unaccented(w) for w in words.to_pylist()]


def test_stem_numbers():
    """stem_codes() against the stemmer; stems begin as heads() says, and words with other ends are their own stems."""
    r = random.Random(2)
    tails = [*ENDS, "ies", "sses", "eed", "ly", "ility", "bility", "ied", "ying", "at", "bl", "iz", "", ""]
    words = {"".join(r.choice("aeiouylstbrz") for _ in range(r.randint(1, 6))) + "".join(r.choice(tails) for _ in range(r.randint(0, 3))) for _ in range(60_000)}
    words |= {"été", "rélationality", "x9s", "ñandúes", "日本", "y", "i"}
    plain = {w: search.folded_stem(w) for w in words}
    for w, s in plain.items():
        u = search.unaccented(w)
        assert u.startswith(tuple(heads(s))) and (u.endswith(ENDS) or u == s) and (len(s) > 1 or len(u) < 7), (w, s)
    stems = {s: i for i, s in enumerate(r.sample(sorted(set(plain.values())), 3000))}
    asked = sorted(words)
    assert scan.stem_codes(stems)(pa.array(asked)).tolist() == [stems.get(plain[w], -1) for w in asked]
    assert porter("ponies") == "poni"


def test_fusion_splits_texts_once(spark):
    """The lists' query shuffles no words and stems no vocabulary: one task's pass over the texts gives what their prompts ask for."""
    import quarrion.operators.scan as module

    kept, stored = [], module.stored
    module.stored = lambda df: kept.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df)
    try:
        assert QUERIES["a8_rrf"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        module.stored = stored
    assert sum("documents" in p or "MapInArrow" in p for p in kept) == 1 and not any("ArrowEvalPython" in p for p in kept[1:])
