import zlib

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrion.llm import bitplane
from quarrion.llm import encode
from quarrion.llm.encode import Encoder, default_path

ODD = ["", " ", "a", "a  b", " lead", "trail ", "a\nb", "a\n\nb", "a \n b", "a\tb  c", "x y z", "it's we'll", "<|endoftext|> a", "\n", "a b\n", "é, ñ. 12 3", "a\x1cb c", "  x", "a" * 300, "a\u00a0 b", "a \u00a0b", "a\n\u00a0 b", "\u3000x \u2003y\u0085 z", "\u180e a", "é à ü", "a \t\n b  ", "hello <|endoftext|> world", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y"]


@pytest.fixture(scope="module")
def both():
    plain = Tokenizer.from_file(default_path())  # with the library's own defaults
    return Encoder(default_path()), lambda t: plain.encode(t, add_special_tokens=False).ids


def same(both, texts, end_id=None):
    ids, counts = both[0].encode(pa.array(texts, pa.string()), end_id)
    assert len(counts) == len(texts) and counts.sum() == len(ids)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == both[1](t or "") + ([] if end_id is None else [end_id]), t
        at += n


def test_odd(both):
    same(both, ODD)
    same(both, ODD[::-1], 7)
    same(both, [None, "a b", None, "", "c"], 0)
    same(both, [])


def test_slices_of_arrays(both):
    whole = pa.array(["skip me", *ODD, "and me"])
    ids, counts = both[0].encode(whole.slice(1, len(ODD)))
    assert ids.tolist() == [x for t in ODD for x in both[1](t)] and len(counts) == len(ODD)


def test_forgetting(both, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_PIECES", 5)
    monkeypatch.setattr(encode, "LONG_PIECE", 3)
    for k in range(4):
        same(both, [f"word{k} of the longer {t}" for t in ODD])


def test_idle_encoders_go(monkeypatch):
    import time

    monkeypatch.setattr(encode, "IDLE", 0.2)
    with encode.encoder() as a, encode.encoder() as b:
        assert a is b
        time.sleep(0.5)
        assert encode._ENCODERS
    with encode.encoder() as c:
        assert c is a
    time.sleep(0.6)
    assert not encode._ENCODERS
    with encode.encoder() as d:
        assert d is not a and d.encode(pa.array(["a b"]))[1].tolist() == [2]


def test_special_strings_as_text():
    e, plain = Encoder(default_path(), True), Tokenizer.from_file(default_path())
    plain.encode_special_tokens = True
    for t in ODD:
        assert e.encode(pa.array([t]))[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_another_kind_of_file():
    """A file whose texts can't be cut at blanks is used on whole texts."""
    path = default_path().replace("byte_bpe_50k", "word_bpe_49k")
    e, plain = Encoder(path), Tokenizer.from_file(path)
    assert not e.cuts
    for t in ODD:
        assert e.encode(pa.array([t]))[0].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_which_files_can_be_cut():
    with open(default_path(), encoding="utf-8") as f:
        good = json.load(f)
    assert encode.cuttable(good)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}), ("pre_tokenizer", None), ("padding", {}), ("model", {"type": "WordPiece"})):
        assert not encode.cuttable(good | {key: value})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é.,!'1\n\t  |#", max_size=30), max_size=5))
def test_any(both, texts):
    same(both, texts)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_ranges(tmp_path, kind):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 60_000, n).astype("<u4")) for i, n in enumerate([0, 1, 70_000, 3, 140_000, 65_536, 0])] + [(None, np.arange(5, dtype="<u4"))]
    with open(tmp_path / "x", "wb") as out:
        w = bitplane.Writer(out, kind)
        for k in range(0, len(docs), 2):
            some = docs[k : k + 2]
            w.add([d for d, _ in some], np.array([len(x) for _, x in some]), np.concatenate([x for _, x in some]), ["n" if d == 2 else None for d, _ in some])
        assert w.close() == (8, sum(len(x) for _, x in docs))
    r = bitplane.open_file(str(tmp_path / "x"))
    whole = np.concatenate([x for _, x in docs])
    for (d, at, ids, note), (d0, ids0) in zip(r.documents(), docs, strict=True):
        assert d == d0 and (ids == ids0).all() and (whole[at : at + len(ids)] == ids0).all() and note == ("n" if d == 2 else None)
    for a, n in ((0, 0), (65_530, 20), (131_000, 80_000), (len(whole) - 5, 5)):
        assert (r.read(a, n) == whole[a : a + n]).all()


def test_token_files(spark, both):
    rows = [(3, "b c"), (1, None), (None, "x"), (2, ""), (2, "dup"), (2, "dup"), (9, "the " * 5000), (10, "hello <|endoftext|> world")]
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, start long, n_tokens int")
    got = sorted((tuple(r) for r in bitplane.token_files(df).collect()), key=lambda r: (r[1], r[2]))
    want = [both[1](t or "") + [0] for _, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])]
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)
    assert [r[0] for r in got] == [None, 1, 2, 2, 2, 3, 9, 10]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert bitplane.token_files(df.limit(0)).collect() == []
