import random
import re
from collections import Counter, defaultdict, namedtuple

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarrion.llm import phrases, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    """All n-grams counted, all cuts and all longer phrases looked at; rows: (lang, text)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        often = {g: a for g, a in c.items() if a >= least and len(g) > 1}
        gone = {g[i : i + m] for g, b in often.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * b >= 80 * often[g[i : i + m]]}
        found = []
        for g, a in often.items():
            if g not in gone:
                s, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got_rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed=3):
    r = random.Random(seed)
    words = ["the", "Of", "new york", "new\tYork  city", "straße", "É", "É,", "a b.c", "x!", "q\nr", "z\x0bz", "\x1c", "\xa0", "日本"]
    rows = [(r.choice(["en", "en", "fr", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "in as much as it is " * 40), ("de", None), ("de", ""), (None, "  "), ("fr", "one two three four five " * 50), ("fr", "one two three four five. " * 9), ("xx\ny", "odd name " * 35)]
    return rows + [("en", "copy of a row that stands often")] * 40


@pytest.mark.parametrize(("least", "top", "bits", "chunk"), [(30, 2000, None, 1 << 21), (5, 2000, 4, 64), (2, 7, 17, 20), (5, 2000, 8, 1)])
def test_against_all_phrases(spark, monkeypatch, least, top, bits, chunk):
    monkeypatch.setattr(phrases, "BLOCK", 16 if bits == 4 else 1 << 16)
    rows = made()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, text string, n int, rank int").repartition(3)
    assert got_rows(phrases.collocations(df, least, top, bits, chunk)) == plain(rows, least, top)


def test_parts_hold_every_phrase_once():
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice("ab  .,") for _ in range(r.randint(0, 90))).encode()
        seen = [Counter() for _ in range(4)]
        chunk = r.randint(1, 30)
        for part, lead in phrases.parts(text, chunk, 4):
            w = phrases.Words(part, "en")
            for n in (1, 2, 3, 4):
                if len(w.starts) >= n:
                    at = [i for i in w.within(n).nonzero()[0] if i + n > lead]
                    seen[n - 1].update(w.phrases(np.array(at, int), n))
        for n in (1, 2, 3, 4):
            want = Counter()
            for piece in re.split(rb"[.,]", text):
                w = piece.split()
                want.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
            assert seen[n - 1] == want, (text, chunk, n)


def test_pruning(spark):
    """Buckets and Apriori rule out most pairs that are rare; languages' words are all counted."""
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], names=["lang", "text"])
    bits, sent = 16, namedtuple("sent", "value")

    def counted(n, marks, full):
        out, buckets = Counter(), np.zeros(1 << bits, int)
        for b in phrases.counting(n, bits, 30, 4, 1 << 16, marks, full)([batch]):
            for r in b.to_pylist():
                if r["block"] is None:
                    out[r["lang"], r["gram"]] += r["n"]
                else:
                    buckets += np.frombuffer(r["data"], "u1")
        return out, np.packbits(buckets >= 30, bitorder="little")

    words, full = counted(1, None, None)
    _, totals = phrases.frequent(spark.createDataFrame(rows, "lang string, text string"))
    assert {r.lang: r.n for r in totals.collect()} == {lang: sum(n for (x, _), n in words.items() if x == lang) for lang, _ in words}
    marks = np.zeros(1 << bits, "u1")
    often = [x for x, n in words.items() if n >= 30]
    for lang in {x for x, _ in often}:
        for b in phrases.marking(1, bits, 30)([pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g)], names=["lang", "gram"]) for g in [[y for x, y in often if x == lang]]]):
            marks |= np.frombuffer(b.to_pylist()[0]["data"], "u1")
    pairs, _ = counted(2, sent(np.packbits(marks >= 30, bitorder="little")), sent(full))
    every, _ = counted(2, sent(np.full(1 << bits - 3, 255, "u1")), sent(np.full(1 << bits - 3, 255, "u1")))
    assert {k for k, n in every.items() if n >= 30} == {k for k, n in pairs.items() if n >= 30}
    assert len(pairs) < 0.5 * len(every)


def test_empty_and_bounds(spark):
    df = spark.createDataFrame([("en", "a b " * 40)], "lang string, text string")
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.selectExpr("lang", "cast(null as string) text")).collect() == []
    with pytest.raises(ValueError):
        phrases.frequent(df, 256)
    assert phrases.bits_for(0) == phrases.FEWEST_BITS and phrases.bits_for(1 << 60) == phrases.MOST_BITS


def test_query(spark):
    """Against all phrases counted, and against SQL."""
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = got_rows(queries.QUERIES["op13_phrase_collocations"](spark, SF))
    assert got == plain(rows) and got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(con.sql(queries.ORACLE["op13_phrase_collocations"]).select(*COLUMNS).fetchall()) == got
