"""Steps whose rows must grow with the input, not with its square."""

from quarrion.operators import graph


def test_hub_meets_prompts_by_its_first_links(spark, monkeypatch):
    """A hub of 300 links that 200 prompts reach: no more than `limit` of its links meet each, and the rows are those of a plain walk."""
    n, limit = 300, 12
    links = [(k, f"o{k}", "hub") for k in range(n)] + [(n, "self", "self"), (n + 1, "o0", "far")]
    df = spark.createDataFrame([(*x, [("v",)]) for x in links], "id long, source string, target string, evidence array<struct<view_id: string>>")
    refs = [(k, f"o{k}") for k in range(200)] + [(7, "o7"), (500, "self")]
    met, cut = [], graph.top
    monkeypatch.setattr(graph, "top", lambda rows, by, *a: (met.append(rows.count()) if by == ["prompt_id"] else None, cut(rows, by, *a))[1])
    found = graph.link_frontier(df, spark.createDataFrame(refs, "prompt_id long, ref string"), ["v"], 2, limit)
    want = set()
    for p in {p for p, _ in refs}:
        front = [r for q, r in refs if q == p]
        seen = set(front)
        for d in (1, 2):
            near = sorted((i, b) for r in front for i, s, t in links for a, b in ((s, t), (t, s)) if a == r)[:limit]
            front = sorted({b for _, b in near} - seen)
            seen |= set(front)
            want |= {(p, r, d, round(0.6**d, 6)) for r in front}
    rows = [(r.prompt_id, r.ref, r.depth, round(r.factor, 6)) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert max(met) <= len(refs) * limit


def test_tokens_are_counted_in_slices(monkeypatch):
    from types import SimpleNamespace

    from quarrion.functions import content

    sizes = []
    encode = lambda texts, add_special_tokens: sizes.append(sum(map(len, texts))) or [SimpleNamespace(ids=x.split()) for x in texts]
    monkeypatch.setattr(content, "ENCODED", 10)
    texts = ["a b", "", "a b c d e f g h", "a", "b c", "d"]
    assert content.counted(SimpleNamespace(encode_batch=encode), texts) == [2, 0, 8, 1, 2, 1]
    assert sizes == [3, 15, 5]


def test_nearest_gives_k_a_task(monkeypatch):
    """A task gives k rows a query whatever its batches, by id where scores tie, and scores a bounded number of cells at once."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from quarrion.operators import fuse

    r = np.random.default_rng(2)
    q, v = r.integers(-2, 3, (5, 4)).astype("f8"), r.integers(-2, 3, (60, 4)).astype("f4")
    batches = [pd.DataFrame({"id": np.arange(i, i + 20), "embedding": list(v[i : i + 20])}) for i in (40, 0, 20)]
    for cells in (1 << 20, 15, 1):
        monkeypatch.setattr(fuse, "CELLS", cells)
        got = pd.concat(fuse._best(SimpleNamespace(value=(list("abcde"), q)), 7)(iter(batches)))
        want = [(p, i, s) for p, row in zip("abcde", q @ v.T, strict=True) for s, i in sorted(((s, i) for i, s in enumerate(row)), key=lambda x: (-x[0], x[1]))[:7]]
        assert list(got.itertuples(index=False, name=None)) == want


def test_memory_meets_prompts_by_few_items(spark, monkeypatch):
    """Many items that hold the same asked terms: as many of each such group and of each prompt as the budget can take are looked at, for the same result."""
    from quarrion.operators import memory

    seen = []
    whole = memory.top
    monkeypatch.setattr(memory, "top", lambda df, by, order, n, *a: seen.append((by, n)) or whole(df, by, order, n, *a))
    ev = [(f"{k:04d}", "error" if k % 3 else "view", f"error {'page' if k % 2 else 'user'} {k}") for k in range(900)]
    facts = [(f"f{k}", f"page {'error' if k % 2 else 'other'} fact", 0.5 + k / 20) for k in range(8)]
    asked = [("p", ["error", "page"], "fix"), ("q", ["user", "1"], "general"), ("r", ["none"], "fix"), ("s", ["page", "error", "fact"], "general")]
    p = spark.createDataFrame(asked, "prompt_id string, terms array<string>, intent string")
    got = memory.merged_memory(p, spark.createDataFrame(facts, "id string, fact string, confidence double"), spark.createDataFrame(ev, "id string, event_type string, content string"), cap=60)
    items = [("fact", i, t, c * 10) for i, t, c in facts if c >= 0.6] + [("error" if k == "error" else "event", i, t, 5.0) for i, k, t in ev]
    want = []
    for pid, terms, intent in asked:
        hits = sorted((-(s + n), k, i, -(-len(t) * 2 // 9)) for k, i, t, s in items if (n := len({x for x in terms if len(x) > 3} & set(t.split()))) and (k != "error" or intent == "fix"))
        used = 0
        for place, (s, k, i, n) in enumerate(hits):
            used += n
            if used > 60 and place:
                break
            want.append((pid, k, i, -s, n))
    assert sorted((r.prompt_id, r.kind, r.id, r.score, r.tokens) for r in got.collect()) == sorted(want)
    assert [n for _, n in seen] == [62, 62]


def test_edges_are_found_by_many_tasks(spark):
    """Parts are short rows, of which one row group of a file has very many; finding a row's edges costs far more than sending it."""
    from quarrion.plans import graph_queries  # noqa: F401
    from quarrion.plans.registry import QUERIES

    assert QUERIES["g1_extracted_edges"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_expansion_reads_edges_once(spark, monkeypatch):
    """Best first takes the edges that the levels have written; repeated edges are as good as one."""
    from quarrion.operators import graph

    made = []
    whole = graph.both_ways
    monkeypatch.setattr(graph, "both_ways", lambda e: made.append(1) or whole(e))
    edges = spark.createDataFrame([("aaa", "bbb", "t", 1.0), ("bbb", "ccc", "t", 0.8), ("aaa", "ddd", "t", 2.0)], "source string, target string, type string, weight double")
    seeds = spark.createDataFrame([(1, "aaa")], "prompt_id long, node string")
    want = [(1, "ddd", 1, 1.0), (1, "bbb", 1, 0.5), (1, "ccc", 2, 0.2)]
    for e in (edges, edges.unionByName(edges).unionByName(edges)):
        assert [tuple(r) for r in graph.expanded(e, seeds, hub=2).orderBy("depth", "score").collect()] == sorted(want, key=lambda r: (r[2], r[3]))
        assert sorted(tuple(r) for r in graph.expanded_exactly(e, seeds, hub=2).collect()) == sorted(want)
    assert len(made) == 4
