"""The packer and the preparation of contents."""

import json
import random
import re
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from quarrion.functions import content as C
from quarrion.operators import compiling
from quarrion.operators import packing as P

CODE = ["a = 1 // x\nb", 's = "// no" // yes\n', "x /* a\nb */ y", "'it\\'s // in' /* out", "`t // ${a}` // c\n\n\nz", "// only\n\n  \nk", '"open // string', "no comments", "", "url = 'http://a/b' // c", '"\\\\" // after', "a / b // c"]


def plain_strip(code):
    """Character by character."""
    out, i, quote, n = [], 0, "", len(code)
    while i < n:
        two = code[i : i + 2]
        if quote:
            out.append(code[i])
            if code[i] == "\\" and i + 1 < n:
                out.append(code[i + 1])
                i += 1
            elif code[i] == quote:
                quote = ""
        elif two == "//":
            while i < n and code[i] != "\n":
                i += 1
            continue
        elif two == "/*":
            end = code.find("*/", i + 2)
            i = n if end < 0 else end + 2
            continue
        else:
            quote = code[i] if code[i] in "\"'`" else ""
            out.append(code[i])
        i += 1
    return re.sub(r"^\s*[\r\n]", "", "".join(out), flags=re.MULTILINE)


def test_comments(spark):
    r = random.Random(3)
    texts = CODE + ["".join(r.choice("ab\"'`/*\\\n ") for _ in range(r.randint(0, 40))) for _ in range(300)] + ["'" + "\\n" * 20_000 + "' // x", "/*" + "a" * 100_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.strip_comments(F.col("t")).alias("s")).collect()
    for x in got:
        assert x.s == plain_strip(texts[x.i]), texts[x.i]


def test_minified_json(spark):
    rows = ['{ "b" : 1,\n "a": [ 1.50, "x  y\\" z", null ] }', '["\\u0041", 1e3]', "not json", '{"a": }', "", "  {}  "]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", C.minify_json(F.col("t")).alias("m")).collect()
    m = {x.i: x.m for x in got}
    assert m[0] == '{"b":1,"a":[1.50,"x  y\\" z",null]}' and json.loads(m[0]) == json.loads(rows[0]) and m[1] == '["\\u0041",1e3]' and m[2] is None and m[3] is None and m[5] == "{}"
    d = spark.createDataFrame([("{ }", "json"), ("{ x", "json"), ("a  \n\n\n\nb", "py")], "c string, l string")
    assert [x[0] for x in d.select(C.prepared(F.col("c"), F.col("l"))).collect()] == ["{}", "{ x", "a\n\nb"]


def test_signals(spark):
    rows = [(["get_context", "Querying", "sessions", "src/core/query-store.ts", "the", "score", "loadUserProfile", "ab"], [" token "]), (None, None), ([f"identifier{k}" for k in range(100)], []), (["x" * 64, ""], None)]
    got = [list(x[0]) for x in spark.createDataFrame(rows, "t array<string>, c array<string>").coalesce(1).select(C.signal_terms(F.col("t"), F.col("c"))).collect()]
    assert {"get_context", "get-context", "context", "Querying", "Query", "sessions", "session", "query-store", "query_store", "query", "loadUserProfile", "Profile", "profile", "token"} <= set(got[0])
    assert not {"the", "score", "ab", "store"} & set(got[0]) and got[0] == sorted(got[0], key=lambda x: (-len(x), x))
    assert got[1] == [] and len(got[2]) == 40 and got[3] == []


def test_exact_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ["hello world", "", None, "a <|endoftext|> b"]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(C.exact_tokens(F.col("t"), path)).collect()
    t = Tokenizer.from_file(path)
    assert [x[0] for x in got] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in rows]


SHAPE = "prompt_id long, id string, source_file string, layer string, line int, content string, score double, symbol_name string, symbol_kind string, parent_symbol string, section_title string, sent boolean"
ASKED = "prompt_id long, terms array<string>, identifiers array<string>"


def hit(i, file="main.ts", lines=30, score=10.0, symbol=None, kind=None, parent=None, sent=False, prompt=1, text=None):
    return (prompt, f"{i:03d}", file, "repo", 1, text if text is not None else "\n".join(f"w{i} line {k}" for k in range(lines)), score, symbol, kind, parent, None, sent)


def test_places(spark):
    hits = [hit(1, score=20.0), hit(2, symbol="loadUser", score=12.0), hit(3), hit(4, "o.ts", text="a session here"), hit(5, "t.test.ts", score=90.0), hit(6, "p.ts"), hit(7, text="session in this file", score=30.0)]
    got = P.ordered(spark.createDataFrame(hits, SHAPE), spark.createDataFrame([(1, ["session"], ["loadUser"])], ASKED), 1200).orderBy("place").collect()
    assert [r.id for r in got] == ["007", "002", "004", "001", "003", "006", "005"] and [r.role for r in got] == [0, 1, 2, 3, 3, 4, 5]
    assert [r.place for r in got] == list(range(1, 8))


def test_forms(spark):
    """The leader takes its share, what fits stays whole, what was sent before and segments of whole functions are named."""
    hits = [hit(1, lines=400, score=50.0, symbol="lead"), hit(2, lines=10), hit(3, lines=10, sent=True), hit(4, "z.ts", lines=900)]
    hits += [hit(5, lines=10, symbol="run", kind="function"), hit(6, lines=3, kind="segment", parent="run")]
    asked = spark.createDataFrame([(1, ["absent"], [])], ASKED)
    placed = P.ordered(spark.createDataFrame(hits, SHAPE), asked, 600)
    got = {r.id: (r.form, r.most) for r in P.chosen(placed, 600, F.lit(5)).collect()}
    assert got["001"] == ("excerpt", int(P.LEAD_SHARE * 600)) and got["002"][0] == got["005"][0] == "body"
    assert got["003"][0] == got["004"][0] == got["006"][0] == "stub"


def test_excerpts(spark):
    text = "\n".join("the session is here" if k == 40 else f"line {k}" for k in range(80))
    rows = [(text, ["session"], 30), (text, [], 12), ("x" * 1000, ["x"], 50), ("", ["a"], 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, t array<string>, m long").coalesce(1).select(P.excerpt(F.col("c"), F.col("t"), F.col("m"))).collect()]
    assert "the session is here" in got[0] and got[0].startswith("line 0\n") and P.GAP in got[0] and compiling.tokens(got[0]) <= 30
    assert got[1].split("\n") == ["line 0", "line 1", "line 2"] and got[2] == "x" * 150 and got[3] == ""


@pytest.mark.parametrize("form", ["markdown", "xml"])
def test_budget_is_kept(spark, form):
    """Many prompts at once: within the budget, bodies as they are, at most three stubs, no hit twice."""
    r = random.Random(5)
    hits, prompts = [], []
    for p in range(40):
        prompts.append((p, r.sample(["session", "loadUser", "w3 line", "verify"], 2), ["loaduser"]))
        for k in range(r.randint(1, 25)):
            text = r.choice([None, "{()};=<>" * r.randint(1, 200), "a]]>b & <c>", ""])
            hits.append(hit(k, f"a/long/common/folder/f{r.randint(0, 4)}.ts", r.choice([1, 20, 100, 300, 1300]), r.random() * 30, r.choice([None, "loadUser", "run"]), r.choice([None, "function", "segment"]), r.choice([None, "run"]), r.random() < 0.2, p, text))
    frames = spark.createDataFrame(hits, SHAPE), spark.createDataFrame(prompts, ASKED)
    for budget in (90, 1200):
        got = compiling.compiled(*frames, budget=budget, form=form).collect()
        assert len(got) >= 38 and all(x.tokens == compiling.tokens(x.output) <= budget and x.n_stub <= P.STUBS for x in got)
        for x in got:
            if form == "xml":
                doc = xml.dom.minidom.parseString(x.output)
                assert len(doc.getElementsByTagName("chunk")) == x.n_body + x.n_excerpt and len(doc.getElementsByTagName("more")) == x.n_stub
            elif x.n_body and not x.n_excerpt:
                assert any(h[5] in x.output for h in hits if h[0] == x.prompt_id)
    assert compiling.compiled(frames[0].limit(0), frames[1]).collect() == []


def test_markdown(spark):
    hits = [hit(k, f"root/some/deep/folder/f{k // 2}.ts", 2, 30.0 - k) for k in range(6)]
    r = compiling.compiled(spark.createDataFrame(hits, SHAPE), spark.createDataFrame([(1, ["none"], [])], ASKED), budget=900).first()
    assert r.output.startswith("`~` = root/some/deep/folder\n## ~/f0.ts\nw0 line 0") and r.output.count("## ~/f1.ts") == 1 and r.n_body == 6
    files = spark.createDataFrame([(["a/b/c.ts", "a/b/d/e.ts"],), (["x.ts", "y.ts"],), (["a/b.ts", "a/b.ts"],), (["a/bc/x", "a/b/x"],)], "f array<string>").coalesce(1)
    assert [x[0] for x in files.select(compiling.common_folder(F.col("f"))).collect()] == ["a/b", "", "a", "a"]
