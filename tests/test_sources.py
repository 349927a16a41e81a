import os

import pytest
from pyspark.sql import functions as F

from quarrion import config
from quarrion.functions import text as T
from quarrion.operators import compiling, graph, retrieve
from quarrion.sources import chunk, files, parse, upkeep

REPO = {
    "src/session/store.py": '"""Sessions."""\nimport json\nfrom util.time import now\n\nclass SessionStore:\n    """Keeps sessions."""\n\n    def create_session(self, user):\n        return json.dumps({"user": user, "at": now()})\n\n    def prune_sessions(self, days):\n        return days\n',
    "src/util/time.py": "def now():\n    return 0\n\ndef format_age(seconds):\n    return f'{seconds}s'\n",
    "src/routes/profile.ts": "import { verifyToken } from '../auth/jwt'\n// Loads the profile of the user\nexport function loadProfile(req) {\n  const user = verifyToken(req)\n  return user\n}\nexport class ProfileController {\n  render(view) {\n    return view\n  }\n}\n",
    "src/auth/jwt.ts": "export const verifyToken = (token) => {\n  return decode(token)\n}\n",
    "docs/guide.md": "---\ntitle: Guide\n---\n# Guide\nIntro words.\n## Tokens\nHow tokens are verified.\n```\n# not a heading\n\ncode\n```\n## Tokens\nAgain.\n",
    "config/app.toml": "[server]\nport = 1\nname = 'x'\n",
    "node_modules/x/index.ts": "export function hidden() {}\n",
    "package-lock.json": "{}",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")
    for path, text in REPO.items():
        os.makedirs(top / os.path.dirname(path), exist_ok=True)
        (top / path).write_text(text)
    (top / "bin.py").write_bytes(b"abc\0def")
    return str(top)


def test_scan(spark, root):
    got = {r.path: r for r in files.scanned(spark, root).collect()}
    assert set(got) == set(REPO) - {"node_modules/x/index.ts", "package-lock.json"}
    assert got["src/auth/jwt.ts"].language == "typescript" and got["docs/guide.md"].parser == "markdown" and got["config/app.toml"].parser == "config"


def test_ignore_rules(spark):
    paths = ["a.log", "keep/b.log", "x/.git/c", "build/o.js", "src/build/p.js", ".env", "../up"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.i for r in df.select("path", files.ignored(F.col("path"), ["**/*.log", "!keep/*.log", "!**/.git/**"], ["/build", "# note"]).alias("i")).collect()}
    assert got == {"a.log": True, "keep/b.log": False, "x/.git/c": True, "build/o.js": True, "src/build/p.js": False, ".env": True, "../up": True}


def test_markdown():
    s = parse.markdown(REPO["docs/guide.md"])
    assert [(x["title"], x["depth"], x["titles"]) for x in s] == [("Guide", 1, ["Guide"]), ("Tokens", 2, ["Guide", "Tokens"]), ("Tokens", 2, ["Guide", "Tokens"])]
    assert "# not a heading" in s[1]["content"] and parse.frontmatter(REPO["docs/guide.md"]) == {"title": "Guide"}


def test_code_parsers():
    py = {(s["kind"], s["name"], s["parent"]) for s in parse.python(REPO["src/session/store.py"])}
    assert py == {("import", "json", None), ("import", "util.time", None), ("class", "SessionStore", None), ("method", "create_session", "SessionStore"), ("method", "prune_sessions", "SessionStore")}
    ts = {s["name"]: s for s in parse.braces(REPO["src/routes/profile.ts"])}
    assert ts["loadProfile"]["kind"] == "function" and ts["loadProfile"]["end"] == 6 and ts["loadProfile"]["docstring"] == "Loads the profile of the user"
    assert ts["render"]["parent"] == "ProfileController" and ts["../auth/jwt"]["kind"] == "import"
    go = {s["name"]: s["kind"] for s in parse.braces("package a\ntype UserStore interface {\n\tGet(id string) User\n}\ntype Pg struct {\n\tdb int\n}\nfunc (p *Pg) Get(id string) User {\n\treturn User{}\n}\n")}
    assert go["UserStore"] == "interface" and go["Pg"] == "struct" and go["Get"] == "method"
    assert parse.python("def broken(:") == []


def test_config_and_contracts():
    assert [s["name"] for s in parse.config("a.toml", REPO["config/app.toml"])] == ["server", "port", "name"]
    assert [s["name"] for s in parse.config("a.json", '{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}')] == ["a", "b"]
    api = '{"openapi": "3.0.0", "paths": {"/u": {"get": {"operationId": "getU"}, "post": {}}}, "components": {"schemas": {"U": {}, "A": {}}}}'
    c = parse.openapi(api)
    assert [o["id"] for o in c["operations"]] == ["getU", "POST /u"] and c["schemas"] == ["A", "U"]
    assert parse.inspected(c, "getU", with_schemas=True)["operations"][0]["path"] == "/u" and parse.inspected(c, "zz")["problem"] == "not found"
    assert parse.openapi('{"a": 1}') is None and parse.openapi("{" * 200) is None
    p = parse.protobuf('syntax = "proto3"; package x.y;\n// service No {}\nmessage Req { string a = 1; }\nservice Pay {\n  rpc Do (Req) returns (stream Res);\n  rpc Up (stream Req) returns (Res) { option x = 1; }\n}\n')
    assert [(o["id"], o["client_stream"], o["server_stream"], o["line"]) for o in p["operations"]] == [("Pay.Do", False, True, 5), ("Pay.Up", True, False, 6)] and p["package"] == "x.y"


def test_splitting():
    text = "para one\n\n```\ncode\n\nmore\n```\n\n" + "long " * 3000
    parts = chunk.split_text(text, 100)
    assert all(compiling.tokens(p) <= 100 for p in parts) and any("code\n\nmore" in p for p in parts)
    body = "\n".join(f"  x{k} = call({k})" if k % 9 else "}" for k in range(400))
    seg = chunk.segments(body)
    assert seg[0][0] == 0 and seg[-1][1] == 399 and all(a[1] + 1 == b[0] for a, b in zip(seg, seg[1:], strict=False)) and len(seg) > 3


def test_chunks(spark, root):
    rows = chunk.chunked(files.scanned(spark, root)).collect()
    assert len({r.id for r in rows}) == len(rows)
    titles = {(r.source_file, r.section_title) for r in rows}
    assert ("src/session/store.py", "SessionStore.create_session") in titles and ("src/auth/jwt.ts", "File Structure") in titles and ("docs/guide.md", "Guide > Tokens") in titles
    again = {r.id for r in chunk.chunked(files.scanned(spark, root)).collect()}
    assert again == {r.id for r in rows}
    assert chunk.chunk_id("a", "t") == chunk.chunk_id("a", "t")


def test_retrieval_end_to_end(spark, root):
    c = chunk.chunked(files.scanned(spark, root)).withColumns({"view_id": F.lit("v"), "layer": F.lit("repo"), "summary": F.lit(None).cast("string"), "importance": F.lit(5), "updated_at": F.lit(0).cast("long"), "line": F.col("start_line")}).cache()
    edges = graph.extracted(c.withColumnRenamed("section_title", "title"))
    prompts = spark.createDataFrame([(1, "How does SessionStore create a session?"), (2, "Where is the user token verified for loadProfile?"), (3, "zzz qqq")], "prompt_id long, prompt string")
    got = retrieve.retrieved(c, edges, prompts).cache()
    by = {}
    for r in got.orderBy("prompt_id", "rank").collect():
        by.setdefault(r.prompt_id, []).append(r)
    assert by[1][0].source_file == "src/session/store.py" and 3 not in by
    assert {"src/routes/profile.ts", "src/auth/jwt.ts"} <= {r.source_file for r in by[2]}
    assert all(len(v) <= config.Config().max_results and [r.rank for r in v] == list(range(len(v))) for v in by.values())
    out = compiling.compiled(got, retrieve.intents(prompts).select("prompt_id", F.transform("identifiers", lambda x: F.lower(x)).alias("terms"))).collect()
    assert {r.prompt_id for r in out} == {1, 2} and all(r.tokens <= 1200 for r in out)
    assert {r.prompt_id: r.tier for r in compiling.tier(got, retrieve.intents(prompts)).collect()}[1].startswith("exact")
    c.unpersist()


def test_store(spark, tmp_path):
    s = upkeep.Store(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([("/r/a", "h1", "v")], "path string, hash string, view_id string")
    assert s.commit({"files": df}) == 1 and s.commit({"other": df}, expected=1) == 2
    with pytest.raises(RuntimeError):
        s.commit({"files": df}, expected=1)
    s.export(f"{tmp_path}/out", "r")
    shape = {"files": (df.schema, ["path"])}
    s.import_(f"{tmp_path}/out", shape, "/r")
    assert s.read("files").count() == 1 and s.generation() == 3
    with pytest.raises(ValueError):
        s.import_(f"{tmp_path}/out", shape, "/elsewhere")


def test_upsert_keeps(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, x string, created long")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k long, x string, created long")
    assert sorted(tuple(r) for r in upkeep.upserted(old, new, ["k"], ("created",)).collect()) == [(1, "a", 5), (2, "c", 6), (3, "d", 9)]


def test_embedding_text(spark):
    df = spark.createDataFrame([("s", ["k1", "k2"], "sym", "title", "body\n" * 100)], "s string, k array<string>, y string, t string, c string")
    assert df.select(T.embedding_text(*(F.col(x) for x in "skytc")).alias("x")).first().x.startswith("s\nk1, k2\nsym\ntitle\nbody")
