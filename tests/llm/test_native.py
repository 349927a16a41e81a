import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarrion.llm import divergence, mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    tri = list(zip(w, w[1:], w[2:], strict=False))
    n, at = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            at |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(at)


ODD = ["", None, " ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c a b c a b", "l\nl\n\nl \n l", "#|# é\x0b\x1cz <&>", "w " * 3000, "a b c d " * 40 + "tail end", "\n", "né né né né"]


def test_base_counts(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in divergence.scores(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert divergence.scores(df.limit(0)).collect() == []


def test_distances_by_hand(spark):
    """The distances and the verdict against a plain computation of the references and the rules."""
    import math

    d = spark.read.parquet(f"{SF}/documents.parquet")
    short = [r.text for r in d.where("lang = 'en'").limit(200).collect()]
    extra = [(90_000 + k, " ".join(" ".join(short).split()[100 * k : 100 * k + 49 + k]), "en") for k in range(20)] + [(90_100, "x1 #2 " * 400, "en"), (90_101, "AB CD " * 90, "fr"), (90_102, "word " * 3000, "xx")]
    d = d.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = d.collect()
    upper = "[" + "".join(chr(x) for x in range(0x600) if chr(x).isupper()) + "]"
    classes = [re.compile(upper if c == r"\p{Lu}" else f"[{c}]") for c in divergence.CLASSES]

    def cls(t):
        found = [len(c.findall(t)) for c in classes]
        blanks = len(t) - sum(map(len, WORD.findall(t)))
        return [*found, blanks, max(len(t) - blanks - sum(found), 0)]

    def jsd(p, q):
        n = sum(p)
        p = [x / n for x in p]
        f = lambda a, m: a * math.log2(a / m) if a > 0 else 0
        return math.sqrt(max(sum(f(a, (a + b) / 2) + f(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2, 0))

    ref, words = defaultdict(lambda: [0] * 6), defaultdict(Counter)
    for r in rows:
        ref[r.lang] = [a + b for a, b in zip(ref[r.lang], cls(r.text), strict=True)]
        words[r.lang].update(WORD.findall(r.text))
    got = {r.doc_id: r for r in divergence.scores(d).collect()}
    kept = set()
    for r in rows:
        g, w = got[r.doc_id], WORD.findall(r.text)
        n, _, _, _, repeats = base(r.text)
        by_class = by_word = None
        if n >= 50 and 100 * repeats <= 50 * n and sum(words[r.lang].values()) >= divergence.ENOUGH:
            total = sum(ref[r.lang])
            if len(r.text) >= divergence.CLASS_CHARS:
                by_class = jsd(cls(r.text), [x / total for x in ref[r.lang]])
            if n >= divergence.WORD_WORDS:
                c, all_ = words[r.lang], sum(words[r.lang].values())
                common = sorted(x for x, k in c.items() if k * divergence.COMMON >= all_)
                mine, q = Counter(w), [c[x] / all_ for x in common]
                p = [mine[x] for x in common]
                by_word = jsd([*p, n - sum(p)], [*q, 1 - sum(q)])
        for mine, plain in ((g.class_distance, by_class), (g.word_distance, by_word)):
            assert (mine is None) == (plain is None) and (mine is None or abs(mine - plain) < 1e-6), r.doc_id
        fine = (by_class or 0) <= divergence.CLASS_LIMIT and (by_word or 0) <= divergence.WORD_LIMIT + divergence.WORD_SLACK / math.sqrt(max(n, 1))
        assert g.kept == (not g.base_failed and fine), r.doc_id
        if g.kept:
            kept.add(r.doc_id)
    assert sorted(r.doc_id for r in divergence.kept(d).collect()) == sorted(kept)
    assert 0.5 * len(rows) < len(kept) < len(rows) and any(got[i].word_distance is None and i in kept for i in got)


def test_quality_labels(spark):
    """Of labelled documents that pass the base rules, junk goes and clean ones stay."""
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    s = divergence.scores(d).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in s.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.15 * n[0, False]


def test_plans_are_native(spark, capsys):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (divergence.kept(d), mixing.mixed(d)):
        df.explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def fill(sizes):
    weights, out = {}, {}
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[k % 3]
    left, rest = sum(sizes.values()), dict(weights)
    while rest:
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            del rest[s]
    return out


def test_mix(spark):
    rows = [(i, "w " * (i * 7919 % 300), "big" if i % 3 else f"s{i % 11}") for i in range(3000)]
    rows += [(10_000 + i, "a b c", "tiny") for i in range(5)] + [(20_000, None, "empty"), (20_001, "x y", None), (None, "q", "big"), (20_002, "v " * 60_000, "big")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        _, text, s = by_id[r.doc_id]
        assert r.size == len((text or "").split()) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    want = fill(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(want[s], 1)
        assert all(r.source_size == sizes[s] for r in got if by_id[r.doc_id][2] == s)
        assert abs(taken[s] - want[s]) <= 300 + 0.002 * want[s] or s == "big" and abs(taken[s] - want[s]) <= 60_000, (s, taken[s], want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).collect() == []
    full = mixing.mixed(df)
    assert full.columns == df.columns
    n = Counter(r.doc_id for r in full.collect())
    assert n == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_rates_solve_the_dual(spark):
    sizes = mixing.sized(spark.createDataFrame([(i, "w " * (i % 50 + 1), "a" if i % 4 else "b") for i in range(2000)], "doc_id long, text string, source string"))
    state = mixing.solve(sizes, mixing.targets(sizes))
    d = mixing._rounded(sizes, state).groupBy("_key", "target").agg(F.sum(F.col("_rate") * F.col("_size")).alias("w")).collect()
    assert len(d) == 2 and all(abs(r.w - r.target) < 1e-5 * r.target for r in d)
