import random
import re
from collections import defaultdict

import pytest
import xxhash

from quarrion.llm import simhash
from quarrion.llm.components import components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(codes, radius=2):
    """{doc: smallest doc reachable}, by comparing all pairs of distinct codes."""
    docs, root = defaultdict(list), {}
    for d, c in codes:
        docs[c].append(d)
    keys = sorted(docs, key=lambda c: min(docs[c]))
    root = {c: c for c in keys}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                if x != y:
                    small, large = sorted((x, y), key=lambda c: min(docs[c]))
                    root[large] = small
    return {d: min(docs[find(c)]) for c in keys for d in docs[c]}


ODD = ["", None, "a", "A b", "a  B\tC", "É é É x", "w " * 30_000, "\x1c x", "ß ẞ İ"]


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_bk_tree():
    r = random.Random(3)
    base = r.getrandbits(64)
    codes = list({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(600)} | {r.getrandbits(64) for _ in range(200)})
    t = simhash.BKTree()
    for c in codes:
        t.add(c)
    for c in codes[:80]:
        for radius in (0, 1, 2, 5):
            assert sorted(t.codes[k] for k in t.near(c, radius)) == sorted(x for x in codes if (x ^ c).bit_count() <= radius)


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randint(2000, 2300), r.randint(2000, 2300)) for _ in range(200)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    seen = defaultdict(set)
    for a, b in pairs:
        if a is not None:
            seen[a].add(b)
            seen[b].add(a)
    for n in seen:
        open_, all_ = [n], {n}
        while open_:
            for m in seen[open_.pop()] - all_:
                all_.add(m)
                open_.append(m)
        assert got.get(n, n) == min(all_)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize(("limit", "sent"), [(4096, 1 << 20), (3, 1 << 20), (3, 0)])
def test_dense_groups(spark, monkeypatch, limit, sent):
    """Trees of one level, and with a low limit of all three, against all pairs."""
    monkeypatch.setattr(simhash, "DENSE", limit)
    monkeypatch.setattr(simhash, "DENSE_SENT", sent)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(3)]
    codes = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(60)} | {r.getrandbits(64) for _ in range(40)}
    rows = [(10_000 - i, c) for i, c in enumerate(sorted(codes))]
    nodes = spark.createDataFrame([(simhash._signed(c), d) for d, c in rows], "fp long, rep long")
    for radius in (1, 2):
        want = classes(rows, radius)
        got = {x.node: x.root for x in components(simhash.links(nodes, radius)).collect()}
        assert {d: got.get(d, d) for d in want} == want


def test_last_level_is_bounded():
    keys = simhash._keys(simhash.LEVELS[-1], simhash.RADIUS)
    assert len(keys) == 120 and all((~m & (1 << 64) - 1).bit_count() == 8 for _, m in keys)
    for blocks in simhash.LEVELS:
        for a, b in ((0, 1), (0, 63), (17, 40)):  # any two bits are outside of some mask
            assert any(not (m >> a & 1 or m >> b & 1) for _, m in simhash._keys(blocks, 2))


def test_hot_fingerprint_and_hub(spark, monkeypatch):
    from quarrion.llm import common as C

    monkeypatch.setattr(C, "hot_limit", lambda rows: 5)
    rows = [(k, "same text here") for k in range(60)] + [(100 + k, f"other {k} words") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes([(i, plain(t)) for i, t in rows])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    hub = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(50, 51), (39, 51)], "a long, b long")
    assert {r.node: r.root for r in components(hub).collect()} == {k: 0 for k in (*range(1, 40), 50, 51)}


def test_repeated_rows_are_chosen_alike(spark):
    rows = [(1, "a b c", x, x) for x in ("z", "k", "m", None)] + [(2, "d e f g", "q", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, row string")
    got = [sorted(map(tuple, simhash.deduplicated(df.repartition(n)).collect())) for n in (1, 3, 4)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2 and simhash.deduplicated(df).columns == df.columns


def test_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, plain(r.text)) for r in d.collect()]
    want = classes(rows)
    got = simhash.near_duplicates(d).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{c:016x}", want[i]) for i, c in rows)
    kept = simhash.deduplicated(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "A b"), (None, "a"), (None, "alone here now"), (40, "A B")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fingerprint string, fp long")
    want = classes([(i, plain(t)) for i, t in rows if i is not None])
    codes = {plain(t): want[i] for i, t in rows if i is not None}
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, f"{plain(t):016x}", want[i] if i is not None else codes.get(plain(t))) for i, t in rows), key=str)
    kept = simhash.deduplicated(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values())) and sum(r.doc_id is None for r in kept) == 2
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_few_edges_take_few_tasks(spark):
    """A session's many shuffle partitions don't make a task each for some edges, in any round."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components(spark.range(1, 900).selectExpr("id AS a", "id - id % 3 AS b"))
        assert 0 < len(got.inputFiles()) <= 16
        assert {x.node: x.root for x in got.collect()} == {k: max(k - k % 3, 0) for k in range(1, 900) if k % 3}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
