import pytest
from pyspark.sql import functions as F

from quarrion import config
from quarrion.functions import text as T
from quarrion.functions.stem import porter
from quarrion.operators import compiling, fuse, graph, memory, rank, retrieve, scope, search


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_config_merge():
    cfg, unknown = config.load({"ignore": ["a"], "diversity_decay": 0}, {"ignore!": ["b"], "graph_depth": 0, "odd": 1, "layer_boosts": {"repo": 2.0}})
    assert cfg.ignore == ("b",) and cfg.diversity_decay == 0 and cfg.graph_depth == 0 and unknown == ["odd"]
    assert cfg.layer_boosts["repo"] == 2.0 and cfg.layer_boosts["session"] == 1.5
    assert config.fingerprint(cfg) != config.fingerprint(config.Config())
    with pytest.raises(ValueError):
        config.load({"max_results": 0})


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("electricity", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("allowance", "allow"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("is", "is")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_intents(spark):
    rows = [(0, "How does loadConfig() call merge_deep?"), (1, "What's broken in \"session store\" today"), (2, "Fix the crash. Where is UserStore defined"), (3, "the of and"), (4, "Explain query command")]
    got = {r.prompt_id: r for r in retrieve.intents(spark.createDataFrame(rows, "prompt_id long, prompt string")).collect()}
    assert {"loadConfig", "merge_deep"} <= set(got[0].identifiers)
    assert got[1].quoted == ["session store"] and got[1].intent == "fix"
    assert "UserStore" in got[2].identifiers and got[2].intent == "fix" and "Where" not in got[2].identifiers
    assert got[3].concepts == [] and got[3].identifiers == []
    assert "queryCommand" in got[4].identifiers and got[4].intent == "explain"


def test_sanitised_queries(spark):
    cases = {'"a" OR "---" OR "b"': '"a" OR "b"', '"---"': "", 'NOT "---"': "", '"a" AND': '"a"', "OR x": "x"}
    for raw, want in cases.items():
        assert one(spark, T.fts_query(F.col("q")), q=raw) == want


def test_text_helpers(spark):
    assert one(spark, T.canonical_space(F.col("q")), q="  a\r\n    b  \n\n\n\n  c") == "a\n b\n\nc"
    assert one(spark, T.name_parts(F.col("q")), q="getUser_ID-HTTPServer") == ["get", "user", "httpserver"]
    assert one(spark, T.escape_cdata(F.col("q")), q="a]]>b") == "a]]]]><![CDATA[>b"
    assert one(spark, T.importance(F.col("q")), q="src/index.ts") > one(spark, T.importance(F.col("q")), q="tests/a.test.ts")
    assert one(spark, T.parse_ref(T.ref(F.lit("v"), "chunk", F.col("q")))["local_id"], q="a b:c/ü") == "a b:c/ü"
    assert "extract" in one(spark, T.match_tokens(F.array("q")), q="extraction") and "getcontext" in one(spark, T.match_tokens(F.array("q")), q="get_context")


def test_rrf(spark):
    rows = [(1, "x", 2.0, "a", 5.0), (1, "x", 2.0, "b", 4.0), (1, "y", 1.0, "a", 1.0)]
    got = {r.id: r for r in fuse.rrf(spark.createDataFrame(rows, "prompt_id long, strategy string, weight double, id string, score double"), trace=True).collect()}
    assert got["a"].score == pytest.approx((2 / 61 + 1 / 61) * 100) and got["b"].score == pytest.approx(2 / 62 * 100)
    assert [c.strategy for c in got["a"].contributions] == ["x", "y"]


HITS = "prompt_id long, id string, source_file string, symbol_name string, symbol_kind string, parent_symbol string, token_count int, score double, exact boolean, hash string"


def hits(spark, rows):
    return spark.createDataFrame(rows, HITS)


def test_containment(spark):
    seg = lambda i, s: (1, i, "f", None, "segment", "run", 290, s, False, i)
    big = (1, "p", "f", "run", "function", None, 3382, 50.0, False, "p")
    got = {r.id: r.score for r in rank.containment(hits(spark, [big, seg("s0", 40.0), seg("s1", 35.0)])).collect()}
    assert got == {"s0": 45.0, "s1": 45.0}
    exact = (*big[:8], True, "p")
    assert [r.id for r in rank.containment(hits(spark, [exact, seg("s0", 40.0), seg("s1", 35.0)])).collect()] == ["p"]
    cls = lambda n, s: (1, "c", "f", "A", "class", None, n, s, False, "c")
    met = lambda i, s: (1, i, "f", i, "method", "A", 50, s, False, i)
    ids = lambda rows: {r.id: round(r.score, 6) for r in rank.containment(hits(spark, rows)).collect()}
    assert set(ids([cls(50, 9.0), met("m", 5.0)])) == {"c", "m"}
    assert ids([cls(600, 10.0), met("m", 5.0), met("n", 4.0)]) == {"m": 5.75, "n": 4.75}
    assert ids([cls(200, 10.0), met("m", 5.0), met("n", 4.0)]) == {"c": 12.25}


def test_dedup_and_caps(spark):
    rows = [(1, "b", "f", None, None, None, 1, 3.0, False, "h"), (1, "a", "f", None, None, None, 1, 3.0, False, "h"), (1, "c", "f", None, None, None, 1, 1.0, False, None), (1, "d", "f", None, None, None, 1, 1.0, False, None)]
    assert sorted(r.id for r in rank.hash_deduplicated(hits(spark, rows)).collect()) == ["a", "c", "d"]
    segs = [(1, f"s{k}", "f", None, "segment", "run", 9, float(k), False, None) for k in range(7)]
    assert len(rank.segment_cap(hits(spark, segs)).collect()) == 4
    zero = {r.id: r.score for r in rank.diversified(hits(spark, rows), config.Config(diversity_decay=0.0, diversity_start=0)).collect()}
    assert zero["a"] == 0 and zero["d"] == 0


EDGES = [("A", "Bee"), ("Bee", "Cee"), ("Cee", "Dee"), ("Bee", "A")]


def test_expansion(spark):
    def edges(pairs):
        return spark.createDataFrame([(a, b, "t", 1.0) for a, b in pairs], "source string, target string, type string, weight double")

    seeds = spark.createDataFrame([(1, "A")], "prompt_id long, node string")
    for f in (graph.expanded, graph.expanded_exactly):
        assert {(r.node, r.depth) for r in f(edges(EDGES), seeds, 2).collect()} == {("Bee", 1), ("Cee", 2)}
        assert len(f(edges([("A", "One"), ("A", "Two"), ("A", "Three")]), seeds, 2, 2).collect()) == 2
        hub = [("A", "Hub")] + [("Hub", f"leaf{k}") for k in range(40)]
        assert f(edges(hub), seeds, 2).count() in (0, 1)


def test_trace(spark):
    links = spark.createDataFrame([("v", "front", "back", "calls"), ("v", "back", "pay", "calls"), ("v", "pay", "work", "emits"), ("w", "pay", "other", "calls")], "view_id string, source string, target string, type string")
    seeds = spark.createDataFrame([(1, "v", "front")], "prompt_id long, view_id string, node string")
    assert [r.path for r in graph.traced(links, seeds, target="work").collect()] == [["front", "back", "pay", "work"]]
    assert {r.node for r in graph.traced(links, seeds, types=["calls"]).collect()} == {"back", "pay"}
    back = spark.createDataFrame([(1, "v", "work")], "prompt_id long, view_id string, node string")
    assert {r.node for r in graph.traced(links, back, "in", depth=2).collect()} == {"pay", "back"}


def test_evidence(spark):
    links = spark.createDataFrame([("l1", [("r1", "v", "f", "h", "c")]), ("l2", [("r1", "v", "f", "x", "c"), ("r9", "v", "f", "h", "c")]), ("l3", [("r9", "w", "g", "h", "c")])], "id string, evidence array<struct<ref:string,view_id:string,file:string,file_hash:string,chunk_hash:string>>")
    now = spark.createDataFrame([("r1", "h", "c", 1)], "ref string, file_hash string, chunk_hash string, generation long")
    assert {r.id: r.status for r in graph.evidence_status(links, now).collect()} == {"l1": "valid", "l2": "invalid", "l3": "unavailable"}
    assert {r.id for r in graph.invalidated(links, views=["w"]).collect()} == {"l1", "l2"}
    files = spark.createDataFrame([("v", "f")], "view_id string, file string")
    assert {r.id for r in graph.invalidated(links, files=files).collect()} == {"l3"}


def test_extracted_edges(spark):
    text = "import { a } from './util'\nOrderService calls PaymentGateway\nworker depends on queue-lib\nuse loadConfig and SessionStore"
    got = {(r.source, r.target, r.type) for r in graph.extracted(spark.createDataFrame([("1", "main.ts", text)], "id string, title string, content string")).collect()}
    assert {("orderservice", "paymentgateway", "calls"), ("worker", "queue-lib", "depends_on"), ("main.ts", "./util", "imports")} <= got and not any(t == "references" for _, _, t in got)  # names in humps are uses, of a code symbol


def test_scope(spark):
    views = spark.createDataFrame([("v1", "p1", True, "main", "ready", 3), ("v2", "p1", False, "dev", "ready", 2), ("v3", "p2", True, "main", "stale", 1)], "view_id string, project_id string, active boolean, branch string, state string, checkout_generation long")
    group = spark.createDataFrame([("p1", "g")], "project_id string, group string")
    ids = lambda df: sorted(r.view_id for r in df.collect())
    assert ids(scope.select_views(views, group, group="g")) == ["v1"]
    assert ids(scope.select_views(views, group, group="g", worktrees=True, branch="dev")) == ["v2"]
    assert ids(scope.select_views(views, group, all=True)) == ["v1", "v2", "v3"]
    with pytest.raises(ValueError):
        scope.select_views(views, group, all=True, project="p1")
    now = spark.createDataFrame([("v1", 3), ("v2", 9), ("v3", 1)], "view_id string, generation long")
    assert ids(scope.readable(views, now)) == ["v1"]


def test_imports(spark):
    i = spark.createDataFrame([(1, "v", "@x/lib/sub", "f"), (2, "v", "lib2", "g"), (3, "v", "nope", "h"), (4, "v", "lib2", "zz")], "import_id long, view_id string, specifier string, name string")
    m = spark.createDataFrame([("v", "@x/lib", "pkg1"), ("v", "lib2", "pkg2")], "view_id string, dependency string, target_package string")
    e = spark.createDataFrame([("pkg1", "sub", "f", "r1"), ("pkg2", "", "g", "r2"), ("pkg2", "", "g", "r3")], "package string, subpath string, name string, ref string")
    assert {r.import_id: (r.status, r.target_ref) for r in scope.resolved_imports(i, m, e).collect()} == {1: ("resolved", "r1"), 2: ("ambiguous", None), 3: ("unknown-dependency", None), 4: ("missing", None)}


def test_stemmed_search(spark):
    got = {r.term: r.stem for r in search.stemmed(spark.createDataFrame([("running",), ("runs",), ("running",)], "term string")).collect()}
    assert got == {"running": "run", "runs": "run"}


def test_compile(spark):
    body = "\n".join(f"line {k} of ordinary text with words" for k in range(200))
    rows = [(1, "a", "src/a.ts", "repo", 1, "function alpha() { return 1 }", 9.0), (1, "b", "src/b.ts", "repo", 4, body + "\nthe needle is here\n" + body, 8.0), (1, "c", "src/c.ts", "session", 1, "note", 7.0), (1, "d", "src/d.ts", "repo", 1, "note", 1.0)]
    hits_ = spark.createDataFrame(rows, "prompt_id long, id string, source_file string, layer string, line int, content string, score double")
    prompts = spark.createDataFrame([(1, ["needle"])], "prompt_id long, terms array<string>")
    for budget in (1200, 400, 60):
        r = compiling.compiled(hits_, prompts, budget=budget).first()
        assert r.tokens <= budget and "alpha" in r.output
    import xml.dom.minidom

    for budget in (1200, 200, 90):
        r = compiling.compiled(hits_, prompts, budget=budget, form="xml").first()
        doc = xml.dom.minidom.parseString(r.output)
        assert r.tokens <= budget and len(doc.getElementsByTagName("chunk")) == r.n_body + r.n_excerpt >= 1
    r = compiling.compiled(hits_, prompts, budget=1200).first()
    assert "needle" in r.output and r.n_excerpt == 1 and r.output.index("note") < r.output.index("alpha")


def test_views_that_fail(spark):
    """Three views, one broken, and a shared store: the others answer, the broken one has a row, the active one counts more."""
    shape = "id string, view_id string, source_file string, layer string, section_title string, content string, summary string, keywords array<string>, hash string, importance long, token_count long, symbol_name string, symbol_kind string, parent_symbol string, file_stem string, line long, updated_at long"

    def chunks(view, layer="repo"):
        rows = [(f"{k}", view, f"src/{w}.ts", layer, w, f"the {w} loads sessions of {view} {k}", "", [w], f"{view}{k}", 5, 9, w, "function", None, w, k, 0) for k, w in enumerate(("loader", "writer", "loadSession"))]
        return lambda: spark.createDataFrame(rows, shape)

    def broken():
        raise OSError("no such store")

    edges = lambda: spark.createDataFrame([("loader", "writer", "calls", 2.0)], "source string, target string, type string, weight double")
    prompts = spark.createDataFrame([(1, "where is loadSession and the loader of sessions")], "prompt_id long, prompt string")
    active = spark.createDataFrame([(1, "b")], "prompt_id long, active_view string")
    views = [retrieve.View("a", chunks("a"), edges), retrieve.View("b", chunks("b"), edges), retrieve.View("c", broken, edges)]
    hits, status = retrieve.over_views(views, prompts, active, retrieve.View("global", chunks("g", "global"), edges))
    said = {r.view_id: (r.ok, r.error) for r in status.collect()}
    assert said == {"a": (True, None), "b": (True, None), "c": (False, "OSError: no such store"), "global": (True, None)}
    got = hits.orderBy("rank").collect()
    score = {(r.view_id, r.id): r.score for r in got}
    assert {v for v, _ in score} == {"a", "b", "global"} and got[0].view_id == "b" and [r.rank for r in got] == list(range(len(got))) and len({r.ref for r in got}) == len(got)
    assert all(score["b", i] == pytest.approx(1.1 * s) for (v, i), s in score.items() if v == "a" and ("b", i) in score)
    with pytest.raises(RuntimeError):
        retrieve.over_views(views[2:], prompts, active)


def test_memory_policy(spark):
    p = spark.createDataFrame([(1, "general", ["parser"]), (2, "fix", ["parser"])], "prompt_id long, intent string, terms array<string>")
    facts = spark.createDataFrame([(1, "the parser is strict", 0.9), (2, "parser old", 0.2)], "id long, fact string, confidence double")
    ev = spark.createDataFrame([(5, "error", "parser failed")], "id long, event_type string, content string")
    got = {(r.prompt_id, r.kind) for r in memory.merged_memory(p, facts, ev).collect()}
    assert got == {(1, "fact"), (2, "fact"), (2, "error")}
    assert memory.merged_memory(p, facts, ev, "off").collect() == []


def test_knowledge(spark):
    from quarrion.operators import knowledge

    ev = "array<struct<view_id:string>>"
    facts = spark.createDataFrame([("view", "v", "old", "user", [])], f"scope string, scope_id string, fact string, provenance string, evidence {ev}")
    new = spark.createDataFrame([("view", "v", "old", "user", [("v",)]), ("group", "g", "x", "code", []), ("project", "p", "y", "code", [("v",)])], facts.schema)
    all_ = knowledge.remembered(facts, new)
    assert sorted(r.fact for r in all_.collect()) == ["old", "y"]
    assert [r.fact for r in knowledge.visible(all_, ["v"], [], "g").collect()] == ["old"]
    hits = spark.createDataFrame([(1, "a", 10.0)], "prompt_id long, id string, score double")
    links = spark.createDataFrame([("l1", "a", "b", [("v",)]), ("l2", "b", "c", [("v",)]), ("l3", "a", "z", [("w",)])], f"id string, source string, target string, evidence {ev}")
    assert {r.id: r.score for r in knowledge.with_links(hits, links, ["v"]).collect()} == {"a": 10.0, "b": 6.0, "c": pytest.approx(3.6)}
    chunks = spark.createDataFrame([("1", "run", "f.ts", 3, "body"), ("2", "Run", "g.ts", 9, "other")], "id string, symbol_name string, source_file string, start_line int, content string")
    edges = spark.createDataFrame([("run", "stop", "calls", 2.0)], "source string, target string, type string, weight double")
    view = {(r.part, r.text) for r in knowledge.symbol_view(chunks, edges, spark.createDataFrame([("RUN",)], "name string")).collect()}
    assert view == {("body", "body"), ("place", "g.ts:9"), ("edge", "out calls stop")}
