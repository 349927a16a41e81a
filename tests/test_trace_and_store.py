"""Traces with limits and stop reasons, the store's versions, lookups, registry rules, and vectors by matrix products."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion.operators import fuse, graph, memory, scope
from quarrion.sources import store, upkeep
from quarrion.streaming import jobs

LINK = "id string, source string, target string, type string, status string"


def rows_of(df):
    return sorted(((r.prompt_id, r.kind, tuple(r.refs), r.reason) for r in df.collect()), key=str)


def test_trace_by_hand(spark):
    links = spark.createDataFrame([("1", "a", "b", "t", "valid"), ("2", "b", "c", "t", "valid"), ("3", "c", "d", "u", "valid"), ("4", "a", "x", "t", "invalid"), ("5", "b", "y", "t", "unavailable")], LINK)
    seeds = spark.createDataFrame([(1, "a"), (2, "z")], "prompt_id long, node string")
    assert rows_of(graph.trace(links, seeds, direction="outgoing")) == [
        (1, "path", ("a", "b", "c", "d"), None), (1, "stop", ("a",), "stale_evidence"), (1, "stop", ("b",), "unavailable_evidence"), (1, "stop", ("d",), "no_recorded_connection"),
        (2, "path", ("z",), None), (2, "stop", ("z",), "no_recorded_connection"),
    ]
    to_c = rows_of(graph.trace(links, seeds.where("prompt_id = 1"), target="c", direction="outgoing"))
    assert (1, "path", ("a", "b", "c"), None) in to_c and len([r for r in to_c if r[1] == "path"]) == 1
    assert (1, "stop", ("b",), "depth_limit") in rows_of(graph.trace(links, seeds, direction="outgoing", depth=1))
    assert (1, "path", ("a", "b"), None) in rows_of(graph.trace(links, seeds, direction="outgoing", types=["t"], nodes=2))
    assert (1, "stop", ("b",), "node_limit") in rows_of(graph.trace(links, seeds, direction="outgoing", nodes=2))
    assert (1, "stop", ("b",), "edge_limit") in rows_of(graph.trace(links, seeds, direction="outgoing", edges=1))
    back = rows_of(graph.trace(links, spark.createDataFrame([(3, "d")], "prompt_id long, node string"), direction="incoming"))
    assert (3, "path", ("d", "c", "b", "a"), None) in back
    star = spark.createDataFrame([(f"{k:03d}", "a", f"n{k:03d}", "t", "valid") for k in range(30)], LINK)
    got = rows_of(graph.trace(star, seeds.where("prompt_id = 1"), direction="outgoing", paths=4))
    assert sum(r[1] == "path" for r in got) == 4 and sum(r[3] == "path_limit" for r in got) == 26


def searched(start, near, target, most):
    """The search by one link after another, level by level; rows (kind, refs, reason)."""
    level, seen, spent, rows, ends = [(start,)], [start], [], set(), []
    for d in range(most["depth"] + 1):
        after = []
        for path in level:
            if path[-1] == target:
                return sorted({*rows, *(("path", p, None) for p in [*ends, path])}, key=str)
            reasons, valid, longer = [], 0, False
            for n, (link, to, status) in enumerate(near.get(path[-1], ())):
                if n == most["edges"]:
                    reasons.append("edge_limit")
                    break
                if status != "valid":
                    reasons.append({"invalid": "stale_evidence"}.get(status, "unavailable_evidence"))
                    continue
                valid += 1
                if to not in seen and d == most["depth"]:
                    reasons.append("depth_limit")
                elif link not in spent and len(spent) == most["edges"]:
                    reasons.append("edge_limit")
                elif to not in seen and len(seen) == most["nodes"]:
                    reasons.append("node_limit")
                else:
                    spent += [link] * (link not in spent)
                    if to not in seen:
                        longer = True
                        seen.append(to)
                        after.append((*path, to))
            rows |= {("stop", path[-1:], why) for why in reasons or (["no_recorded_connection"] if not valid else [])}
            if not longer and target is None:
                ends.append(path)
        level = after
    rows |= {("stop", p[-1:], "path_limit") for p in ends[most["paths"] :]}
    return sorted({*rows, *(("path", p, None) for p in ends[: most["paths"]])}, key=str)


def test_trace_sees_enough(spark):
    """All searches at once, by counts, give what each gives link by link."""
    r = random.Random(4)
    links = [(f"{k:04d}", f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}", "t", r.choice(["valid"] * 8 + ["invalid"])) for k in range(300)]
    links = [x for x in links if x[1] != x[2]]
    near: dict = {}
    for i, a, b, _, s in links:
        near.setdefault(a, set()).add((i, b, s))
        near.setdefault(b, set()).add((i, a, s))
    near = {n: sorted(v) for n, v in near.items()}
    df, seeds = spark.createDataFrame(links, LINK), spark.createDataFrame([(k, f"n{k}") for k in range(8)], "prompt_id long, node string")
    for limits in ({"depth": 2}, {"nodes": 9, "edges": 14}, {"edges": 12, "paths": 3, "depth": 3}):
        most = {"depth": 6, "nodes": 50, "edges": 100, "paths": 20} | limits
        want = sorted(str((k, *row)) for k in range(8) for row in searched(f"n{k}", near, None, most))
        assert sorted(map(str, rows_of(graph.trace(df, seeds, **limits)))) == want, limits
    to = sorted(str((k, *row)) for k in range(8) for row in searched(f"n{k}", near, "n33", {"depth": 3, "nodes": 40, "edges": 60, "paths": 20}))
    assert sorted(map(str, rows_of(graph.trace(df, seeds, "n33", depth=3, nodes=40, edges=60)))) == to


def test_extracted_edges(spark):
    code = "orders service -> billing\nJob consumes queue:mail-x and depends on Redis\nORDER_TOTAL and API_KEY in api/v1/orders, TODO, json\nconst x = require('left-pad')\nimport y from 'react'\nfrom os.path import join\nloadUser(UserStore, The)"
    rows = [("1", "ORDER_SHEET and user-service", code, "src/a.ts", "code", "loadUser", "function", "a"), ("2", "T", code, "x/node_modules/b.ts", "code", "s", None, "b"), ("3", None, "a -> b, a->c", None, None, None, None, None), ("4", "", None, None, None, None, None, None), ("5", "t", "import { Alpha } from './x'", "c.ts", "code", "imp", "import", "c")]
    c = spark.createDataFrame(rows, "id string, title string, content string, source_file string, file_type string, symbol_name string, symbol_kind string, file_stem string")
    got = {(r.source_chunk_id, r.source, r.target, r.type, r.weight) for r in graph.extracted(c).collect()}
    want = {("1", "orders-service", "billing", "produces", 2.0), ("1", "job", "queue:mail-x", "consumes", 2.0), ("1", "and", "redis", "depends_on", 2.0)}
    want |= {("1", t, x, "references", 1.0) for t in ("order_sheet", "user-service") for x in ("queue:mail-x", "order_total", "api_key", "api/v1/orders")}
    want |= {("1", "loadUser", x, "uses", 0.8) for x in ("Redis", "ORDER_TOTAL", "API_KEY", "TODO", "UserStore", "ORDER_SHEET")}
    want |= {("1", "loadUser", x, "imports", 2.0) for x in ("left-pad", "react", "os.path")} | {("3", "a", "b", "produces", 2.0)}
    want |= {("5", "imp", "Alpha", "imports", 2.0), ("5", "imp", "./x", "imports", 2.0)}
    assert got == want
    many = " ".join(f"NAME_{'X' * k}" for k in range(1, 15))
    assert graph.extracted(spark.createDataFrame([("1", many.lower().upper(), many)], "id string, title string, content string")).count() <= 50


def test_store_versions(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = upkeep.Store(spark, root)
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    assert s.generation() == 0 and s.commit({"t": df}, note="x") == 1 and s.about() == {"note": "x"}
    won, lost = [], []

    def write(k):
        try:
            won.append(upkeep.Store(spark, root).commit({f"w{k}": df}, expected=1))
        except RuntimeError:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won == [2] and len(lost) == 3 and s.generation() == 2 and s.read("t").count() == 1
    with pytest.raises(ValueError):  # it would replace rows that nobody has said were read
        s.commit({"t": df})
    assert s.commit({"t": df.unionByName(df)}, expected=2) == 3 and s.read("t").count() == 2 and s.read("t", 2).count() == 1
    with pytest.raises(RuntimeError):
        s.commit({"t": df}, expected=1)
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.endswith(".manifest")]


def test_snapshots_and_appends(spark, tmp_path):
    """A writer that has read what another then changes fails or starts anew; others, and appends, go through."""
    s = upkeep.Store(spark, f"file://{tmp_path}/s")
    one = lambda *x: spark.createDataFrame([(y,) for y in x], "path string")
    names = lambda t: sorted(r.path for r in s.read(t).collect())
    s.commit({"files": one("a"), "other": one("o")})
    pinned, late = s.snapshot(), s.snapshot()
    mine = pinned.read("files")
    s.update(lambda x: {"files": x.read("files").unionByName(one("b"))})
    assert sorted(r.path for r in mine.collect()) == ["a"] and names("files") == ["a", "b"]
    with pytest.raises(upkeep.Conflict):
        pinned.commit({"files": mine.unionByName(one("c"))})
    with pytest.raises(upkeep.Conflict):  # it has read what changed, though it writes something else
        pinned.commit({"sums": mine})
    assert late.commit({"new": one("n")}) == 3 and names("new") == ["n"] and names("files") == ["a", "b"]
    tries = []

    def slow(x):
        tries.append(x.generation)
        if len(tries) == 1:  # another writer comes between
            s.update(lambda y: {"files": y.read("files").unionByName(one("d"))})
        return {"files": x.read("files").unionByName(one("c"))}

    s.update(slow)
    assert len(tries) == 2 and names("files") == ["a", "b", "c", "d"]
    before = s.snapshot()
    assert s.append("log", one("x")) and before.commit(append={"log": one("y")}) and names("log") == ["x", "y"]
    assert len(s.snapshot().tables["log"]) == 2 and len(list((tmp_path / "s").glob("*.manifest"))) == 0
    one("p", "q").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        store.appended(s, spark.readStream.schema("path string").parquet(str(tmp_path / "in")), "log", str(tmp_path / "cp")).awaitTermination()
    assert names("log") == ["p", "q", "x", "y"]
    kept = s.snapshot()
    assert s.vacuum(keep=1, hours=24) == 0 and s.vacuum(keep=1, hours=-1) > 0
    assert names("log") == ["p", "q", "x", "y"] and names("files") == ["a", "b", "c", "d"] and kept.generation == s.generation()


def test_jobs(spark, tmp_path):
    day = memory.DAY
    s = upkeep.Store(spark, f"file://{tmp_path}/s")
    e = spark.createDataFrame([(k, k * day) for k in range(100)], "id long, created_at long")
    f = spark.createDataFrame([("1", "f", "general", 0.9, 0, 0, 1)], "id string, fact string, category string, confidence double, created_at long, last_accessed long, access_count int")
    s.commit({"prompts": e, "events": e, "facts": f})
    jobs.prune(s, F.lit(99 * day), prompts=5, events=1000)
    assert s.read("prompts").count() == 5 and s.read("events").count() == 31
    jobs.decay(s, F.lit(400 * day))
    assert s.read("facts").first().confidence < 0.9
    ran = []
    q = jobs.every(spark, "0 seconds", lambda: ran.append(1), str(tmp_path / "cp"))
    try:
        for _ in range(60):
            if ran:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert ran
    many = spark.createDataFrame([(f"p{k}", "change", k) for k in range(12)], "path string, type string, ts int")
    assert jobs.replayed(many, 11)[0] and jobs.replayed(many, 12)[1].count() == 12


def test_lookups_and_stores(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None)], "id string, v string")
    b = spark.createDataFrame([("2", "far"), ("3", "far")], "id string, v string")
    got = {(r.id, r.store) for r in upkeep.united({"near": a, "far": b}).collect()}
    assert got == {("1", "near"), ("2", "near"), ("3", "far")}
    assert [r.id for r in upkeep.lookup(a, v=None).collect()] == ["2"] and upkeep.lookup(a, id=["1", "3"]).count() == 1 and upkeep.lookup(a, b.select("id")).count() == 1


def test_binding(spark):
    t = {"files": spark.createDataFrame([("p", "v1")], "path string, view_id string")}
    view = {"view_id": "v2", "root_path": "/r", "head": "h"}
    tables, identity = scope.bound(t, {}, view)
    assert tables["files"].first().view_id == "v2" and identity == view | {"needs_reindex": False}
    same, again = scope.bound(tables, identity, view)
    assert same is tables and again is identity
    _, moved = scope.bound(tables, identity, view | {"root_path": "/q"})
    assert moved["needs_reindex"] and moved["root_path"] == "/q"


def test_import_suggestions(spark):
    hits = spark.createDataFrame([(1, f"h{k}", "v1", f"f{k}.ts", 10.0 - k) for k in range(5)] + [(1, "md", "v1", "x.md", 99.0)], "prompt_id long, id string, view_id string, source_file string, score double")
    imports = spark.createDataFrame([("v1", f"f{k}.ts", f"s{k}", f"./m{j}", "import", j, j % 2 == 0) for k in range(5) for j in range(4)], "view_id string, source_file string, source string, specifier string, mode string, k int, local boolean")
    resolved = spark.createDataFrame([("v1", "s0", "./m1", "import", "t1", "v2"), ("v1", "s0", "./m3", "import", "t3", "v1"), ("v1", "s4", "./m0", "import", "t9", "v2")], "view_id string, source string, specifier string, mode string, target string, target_view string")
    links, open_ = scope.learned_imports(hits, imports, resolved)
    assert [(r.source, r.target) for r in links.collect()] == [("s0", "t1")]
    assert sorted((r.source, r.specifier) for r in open_.collect()) == [("s0", "./m0"), ("s0", "./m2"), ("s1", "./m0")]  # six attempts: four and two


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(fuse, "QUERIES", 3)
    r = np.random.default_rng(3)
    v = [(k, [float(x) for x in r.integers(-3, 4, 6)]) for k in range(200)] + [(999, None)]
    df = spark.createDataFrame(v, "id long, embedding array<float>").repartition(5)
    q = [(f"q{k}", v[k][1]) for k in range(10)]
    got = {(x.prompt_id, x.rank): (x.id, x.score) for x in fuse.nearest(spark.createDataFrame(q, "prompt_id string, q array<float>"), df, 7).collect()}
    for name, vec in q:
        best = sorted((-sum(a * b for a, b in zip(vec, w, strict=True)), k) for k, w in v if w is not None)[:7]
        assert [got[name, i] for i in range(7)] == [(k, -s) for s, k in best]
    assert fuse.nearest(spark.createDataFrame([], "prompt_id string, q array<float>"), df).collect() == []


def test_memory_always(spark):
    facts = spark.createDataFrame([(str(k), f"fact number {k}", 0.6 + k / 1000) for k in range(300)], "id string, fact string, confidence double")
    events = spark.createDataFrame([(k, "error" if k % 2 else "view", f"event {k}") for k in range(50)], "id long, event_type string, content string")
    p = spark.createDataFrame([(1, ["x"], "fix"), (2, ["y"], "general")], "prompt_id long, terms array<string>, intent string")
    got = memory.merged_memory(p, facts, events, "always")
    per = {k: [r for r in got.collect() if r.prompt_id == k] for k in (1, 2)}
    assert all(0 < len(v) and sum(r.tokens for r in v) <= 120 for v in per.values()) and all(v[0].kind == "fact" for v in per.values())
