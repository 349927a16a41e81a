import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrion.llm import langid, packing, toxicity, vafile
from quarrion.llm.encode import default_path

SF = "/root/testdata/sf0.01"


def brute_top(rows, is_query, k):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if is_query(i):
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))), j) for j, v in good if j != i)
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize(("held", "tasks"), [(1 << 21, 8), (40, 8), (40, 1)])
def test_va_search(spark, monkeypatch, held, tasks):
    monkeypatch.setattr(vafile, "HELD", held)
    monkeypatch.setattr(vafile, "tasks", lambda spark: tasks)
    monkeypatch.setattr(vafile, "SEGMENT", 64)
    monkeypatch.setattr(vafile, "BLOCK", 7)
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(80)]
    rows += [(2000, None), (2001, [None] + [0.0] * 7), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2004, [3.0, 1.0]), (2005, []), (2006, [1e3] * 8), (2007, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(a.vec_id, a.embedding) for a in df.collect()]
    for bits in (2, 4, 6):
        got = sorted(tuple(x) for x in vafile.top_k(df.repartition(3), F.col("vec_id") % 20 == 0, 5, bits).collect())
        assert got == brute_top(rows, lambda i: i % 20 == 0, 5)
    assert vafile.top_k(df.limit(0), F.lit(True)).collect() == []
    few = df.where("vec_id < 3")
    assert len(vafile.top_k(few, F.lit(True)).collect()) == 6


def test_va_huge_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 16), 1.0, 2.0**20]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in vafile.top_k(df, F.lit(True), 3).collect())
    assert got == brute_top(rows, lambda i: True, 3)


def test_va_reads_few(spark, tmp_path):
    """Of clustered vectors, most are ruled out by their cells."""
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(2000).toPandas()
    folder = str(tmp_path)
    m = vafile.write_files(spark.createDataFrame(d).coalesce(1), folder).collect()
    ids, x = d.vec_id.to_numpy()[:50], np.floor(64 * np.stack(d.embedding[:50]).astype("f8")).astype("i8")
    s = vafile.Search(ids, x, 20)
    for seg in vafile.segments_of([r.path for r in m]):
        s.scan(seg)
    s.resolve()
    assert s.n_read < 0.3 * 50 * len(d)


def test_language_filter(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, "12 34 !!"), (-4, "x"), (None, "the and of the"), (-5, "the " * 20_000)]
    df = d.select("doc_id", "text", "lang", F.lit(1).alias("score")).unionByName(spark.createDataFrame([(i, t, None, 1) for i, t in odd], "doc_id long, text string, lang string, score int"))
    got = langid.identified(df).collect()
    truth = {r.doc_id: r.lang for r in d.collect()}
    assert len(got) == df.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (-1, -2, -3))
    assert by[-5][0].lang_pred == "en" and by[None][0].lang_pred == "en" and by[-4][0].lang_pred in set(truth.values())
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert langid.identified(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_filter_by_plain_counts(spark):
    """Kept n-grams, lookups and predictions against plain sets, one n-gram at a time."""
    r = random.Random(12)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "абвгдежз"}
    rows = [(k, " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(1, 80))), lang) for k, lang in enumerate(list(alphabets) * 40)]
    rows += [(1000, "², ½ 5 _", "aa"), (1001, "Ⅷ", "bb"), (1002, "ª", "cc"), (1003, "Ab CD" * 9, None), (1004, None, "aa"), (1005, "l" * 70_000, "bb"), (1005, "l" * 70_000, "bb")]
    d = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    f = langid.fit(d)

    def plain(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower())
        return [t[k : k + 4] for k in range(len(t) - 3) if "  " not in t[k : k + 4]]

    counts = {x: Counter() for x in alphabets}
    for i, t, lang in rows:
        if t and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(plain(t[: langid.SAMPLE_CHARS]))
    kept = {lang: {g for g, n in c.items() if n >= max(2, sum(c.values()) * langid.SHARE)} for lang, c in counts.items()}
    assert f.langs == sorted(alphabets)
    got = {x.doc_id: x for x in langid.identified(d, f).collect()}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        mine = plain(t)
        exact = [sum(g in kept[x] for g in mine) for x in f.langs]
        n, found = f.counts(t)
        assert n == len(mine) and all(e <= c for e, c in zip(exact, found, strict=True))  # no false negatives
        assert sum(found) - sum(exact) <= 1 + 0.01 * n * len(f.langs)
        if sorted(exact)[-1] > sorted(exact)[-2] + 2:
            assert got[i].lang_pred == f.langs[exact.index(max(exact))]
        right = sorted((max((c - n * w) / (1 - w), 0) for c, w in zip(found.tolist(), f.wrong, strict=True)), reverse=True)
        assert abs(got[i].score - (right[0] / (right[0] + right[1]) if right[0] else 0)) < 1e-12


def test_bitmask_filter_holds_what_it_was_given():
    r = np.random.default_rng(2)
    known = {f"l{i:03d}": r.integers(0, 2**63, 500).astype("u8") for i in range(70)}
    f = langid.Filter.build(known)
    assert f.masks.shape[0] == 2
    for i, lang in enumerate(f.langs):
        got = f.masks[i // 64][langid._slots(known[lang])[0]]
        for s in langid._slots(known[lang])[1:]:
            got = got & f.masks[i // 64][s]
        assert ((got >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert (f.wrong < 0.01).all()


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, " \n"), (None, "you idiot moron scum loser worthless clown pathetic trash"), (-3, "word " * 30_000)], "doc_id long, text string")
    odd = odd.unionByName(odd.where("doc_id = -3")).withColumn("score", F.lit(1)).withColumn("predicted", F.lit("x"))
    rows = d.join(labels.select("doc_id"), "doc_id").select("doc_id", "text", F.lit(1).alias("score"), F.lit("y").alias("predicted"))
    got = toxicity.scored(rows.unionByName(odd), labels.withColumn("text", F.lit(1))).toPandas()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert ((m.score >= 0.3).astype(int) == m.predicted).all()
    # 329 toxic training documents in four languages: few for dictionaries (more of them: the next test).
    assert m[m.toxic == 1].predicted.mean() > 0.6 and m[m.toxic == 0].predicted.mean() < 0.02
    assert got[got.doc_id.isna()].predicted.item() == 1
    assert got[got.doc_id == -3].score.nunique() == 1
    blank = got[got.doc_id.isin([-1, -2])].score
    assert blank.nunique() == 1 and 0 < blank.iloc[0] < 0.3


def test_toxicity_with_more_labels(spark):
    """A table made here: ordinary words by rank, insults of a small list in every tenth text; more labels than the supplied tables have."""
    r = random.Random(12)
    syllables = ["ba", "de", "ki", "lo", "mu", "ner", "sta", "tri", "vo", "zan", "pel", "gur"]
    plain = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    weights = [1 / (k + 2) for k in range(3000)]
    insults = ["scumbag", "imbecile", "moron", "parasite", "vermin", "halfwit", "cretin", "dimwit"]
    rows, marks = [], []
    for k in range(6000):
        words = r.choices(plain, weights, k=r.randint(60, 200))
        if k % 10 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), f"you {r.choice(insults)} {r.choice(insults)}")
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 10 == 0)))
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    m = toxicity.scored(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert m[m.toxic == 1].predicted.mean() > 0.9 and m[m.toxic == 0].predicted.mean() < 0.05


def test_compression_distances():
    """Lengths and distances by plain calls, one window at a time."""
    import zstandard

    plain, toxic = b" the quick brown fox jumps " * 3, [b" utter scoundrel and knave ", b" knave and scoundrel utterly "]

    def length(content, x):
        p = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content + toxicity.PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(x + toxicity.PAD))

    words = "the quick scoundrel knave brown fox utter jumps and".split()
    r = random.Random(2)
    text = " ".join(r.choice(words) for _ in range(400))
    some = toxicity.windows(text)
    assert b"".join(some).split() == text.encode().split() and all(len(x.split()) == toxicity.WORDS for x in some)
    m = toxicity.Model(plain, toxic).open()
    want = [max(0, min(length(plain, x) - length(t + plain, x) for t in toxic)) for x in some]
    assert toxicity.distances(m.plain, m.others, some).tolist() == want and max(want) >= 4
    counts = [sum(w >= x for w in want) for x in toxicity.LEVELS]
    f = m.features(text)
    assert f[0] == 1 and np.allclose(f[1:4], np.log1p(counts)) and np.allclose(f[4:], [min(100 * c / len(some), 25) for c in counts])


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(d, labels).collect()} == {0.0}
    assert {r.score for r in toxicity.scored(d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(d.limit(0), labels).collect() == []
    assert toxicity.clean(d, labels).columns == d.columns


def test_packing(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    odd = [(5000, None, "src0"), (5001, "", None), (5002, "dup", "x"), (5002, "dup", "x"), (None, "no id", "x"), (5003, "the " * 6000, "src1"), (5004, "hello <|endoftext|> world", "src1")]
    df = d.unionByName(spark.createDataFrame(odd, d.schema)).withColumn("length", F.lit(1))
    got = packing.pack(df).collect()
    t = Tokenizer.from_file(default_path())
    docs = Counter()
    for r in df.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        docs[(r.doc_id, ids.tobytes())] += 1
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.LENGTH
    assert sorted(by_seq) == list(range(len(by_seq)))
    fills = sorted(sum(r.length for r in rows) for rows in by_seq.values())
    assert sum(x < packing.LENGTH for x in fills) <= 4  # a part's last
    want = Counter()
    for (i, raw), n in docs.items():
        for r in by_doc[i, len(raw) // 4]:
            pass
        want[i, len(raw) // 4] += n
    covered = Counter()
    for (i, n), rows in by_doc.items():
        raw = [x for j, x in docs if j == i and len(x) // 4 == n]
        assert len(raw) == 1
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(raw[0][4 * r.start : 4 * (r.start + r.length)])
            for k in range(r.start, r.start + r.length):
                covered[i, n, k] += 1
    assert all(covered[i, n, k] == want[i, n] for i, n in want for k in range(n)) and sum(covered.values()) == sum(n * c for (_, n), c in want.items())
    assert packing.pack(df.limit(0)).collect() == []


def test_parts_follow_the_text_alone(spark, monkeypatch):
    """The same rows, and as little padding, at 1, 8 and 200 shuffle partitions, in one part and in several."""
    assert [packing.n_parts(x) for x in (0, 1, 4 << 20, (4 << 20) + 1, 1 << 30, 1 << 34, 1 << 46)] == [1, 1, 1, 2, 256, 1024, 1 << 20]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    size = sum(len((r.text or "").encode()) for r in d.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for least, parts in ((packing.LEAST_BYTES, 1), (-(-size // 3), 3)):
            monkeypatch.setattr(packing, "LEAST_BYTES", least)
            assert packing.n_parts(size) == parts
            results = []
            for n in (1, 8, 200):
                spark.conf.set("spark.sql.shuffle.partitions", str(n))
                results.append(sorted(map(repr, packing.pack(d).collect())))
                fills = Counter()
                for r in packing.pack(d).select("sequence_id", "length").collect():
                    fills[r.sequence_id] += r.length
                assert sum(x < packing.LENGTH for x in fills.values()) <= parts
            assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_proportions_and_carry():
    """Every prefix of windows is near the shares, and a part's deficits continue in the next."""
    from collections import deque

    r = random.Random(1)
    docs = {s: [r.randint(1, 3000) for _ in range(n)] for s, n in (("a", 200), ("b", 100), ("c", 30))}
    total = {s: sum(v) for s, v in docs.items()}
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    deficits, served, first = dict.fromkeys(docs, 0.0), Counter(), 0
    for part in range(3):
        queues = {s: deque((k, np.zeros(n, "<u4")) for k, n in enumerate(v[part::3])) for s, v in docs.items()}
        size = sum(len(x) for q in queues.values() for _, x in q)
        for _, _, ids, _, seq, _, s in packing.packed(queues, shares, deficits, first, 1024, 256):
            served[s] += len(ids)
            done = seq + 1 - first
            if part == 0 and done * 1024 < 0.9 * size:
                assert all(abs(served[x] - shares[x] * 1024 * done) <= 1024 + 3 * 256 for x in docs)
        first += -(-size // 1024)
    assert served == total


def test_everything_is_registered():
    from quarrion.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_equal_windows_are_compressed_once(monkeypatch):
    """A window that comes again, in another text too, has the distance that it had, and isn't compressed again."""
    seen = []
    whole = toxicity.distances
    monkeypatch.setattr(toxicity, "distances", lambda a, b, some: seen.extend(some) or whole(a, b, some))
    m = toxicity.Model(b" the quick brown fox jumps " * 3, [b" utter scoundrel and knave ", b" knave and scoundrel utterly "]).open()
    text = "utter scoundrel and knave the quick brown fox " * 5
    first = m.features(text)
    assert m.features(text + text) == m.features(text + text) and m.features(text) == first
    assert sorted(seen) == sorted(set(toxicity.windows(text)))
