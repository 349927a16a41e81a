import base64
import hashlib
import io
import os
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarrion.llm import binpack, warc
from quarrion.llm import common as C

SF = "/root/testdata/sf0.001"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_brute(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "x y", None), (4, "u", ""), (5, "u", "é\r\n\r\nz"), (6, "u", "b" * 200_000), (7, "u", "a"), (7, "u", "a"), (None, "u", "only"), (None, "u", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b, last = (h or "").encode(), best[h or ""]
        first = last == -1 or i == last
        want.append((i, len(b), digest(b), "response" if first else "revisit", None if first else last))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("big", [False, True])
def test_zip64_directory(monkeypatch, big):
    if big:  # the writer of the standard library then uses ZIP64 fields from 100 bytes on
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(5):
            with z.open(f"archive/é{k}", "w", force_zip64=True) as m:
                m.write(bytes([k]) * 300)
        z.comment = b"PK-comment"
    data = out.getvalue()
    assert (warc.END64 in data) == big
    p = warc.Package(io.BytesIO(data), len(data))
    assert len(p.members) == 5 and p.read("archive/é3", 10, 4) == b"\3" * 4 and p.read("archive/é4", 290, 50) == b"\4" * 10


def test_end_record_in_the_comment_and_full_counts():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x" * 10)
        z.comment = b"see PK\5\6 and then some bytes, more than twenty-two"
    data = out.getvalue()
    assert warc.Package(io.BytesIO(data), len(data)).read("a") == b"x" * 10
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(65_535):
            z.writestr(str(k), b"")
    data = out.getvalue()
    assert warc.END64 not in data and len(warc.Package(io.BytesIO(data), len(data)).members) == 65_535


def test_short_zip64_field_is_refused(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x" * 300)
    data = bytearray(out.getvalue())
    k = data.rfind(b"PK\1\2")
    data[k + 46 + 1 + 2 : k + 46 + 1 + 4] = (4).to_bytes(2, "little")  # the field's length in the central directory
    with pytest.raises(ValueError, match="damaged"):
        warc.Package(io.BytesIO(bytes(data)), len(data))


@pytest.mark.parametrize("kind", ["cdxj", "cdx.gz", "deflated"])
@pytest.mark.parametrize("packed", [True, False])
def test_packages_of_others(kind, packed):
    """Index lines with key and time, text numbers and file names; indexes in gzip or deflated; plain and gzip records."""
    import gzip
    import json

    whole, lines = b"", ["!meta 0 {}"]
    for k in range(40):
        body = f"HTTP/1.1 200 OK\r\n\r\nhello {k}".encode()
        raw = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID:<urn:uuid:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        data = gzip.compress(raw) if packed else raw
        lines.append(f"org,example)/{k} 20240101000000 " + json.dumps({"url": f"http://example.org/{k}", "length": str(len(data)), "offset": str(len(whole)), "filename": "a.warc"}))
        whole += data
    index = "\n".join(lines).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc", whole)
        if kind == "cdx.gz":
            z.writestr("indexes/index.cdx.gz", gzip.compress(index[:1000]) + gzip.compress(index[1000:]))
        else:
            z.writestr("indexes/index.cdxj", index, zipfile.ZIP_DEFLATED if kind == "deflated" else zipfile.ZIP_STORED)
    data = out.getvalue()
    p = warc.Package(io.BytesIO(data), len(data))
    got = [p.record(e) for e in p.indexes()]
    assert [h["WARC-Record-ID"] for h, _ in got] == [f"<urn:uuid:{k}>" for k in range(40)]
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [f"hello {k}".encode() for k in range(40)]


def test_written_records_and_index(spark, tmp_path):
    df = spark.createDataFrame([(2, "http://Shop.Example.org/a b", "x"), (1, "http://example.org/", "y")], "page_id long, url string, html string").coalesce(1)
    m = warc.write_packages(df, str(tmp_path)).collect()
    p = warc.open_package(m[0].path)
    lines = p.read(warc.INDEX).decode().splitlines()
    assert lines == sorted(lines) and sorted(x.split(" ", 2)[0] for x in lines) == ["org,example)/", "org,example,shop)/a%20b"] and {x.split()[1] for x in lines} == {"19700101000000"}
    heads = [p.record(e)[0] for e in p.indexes()]
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(h) for h in heads)


def test_compressed_member_is_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    p = warc.Package(io.BytesIO(out.getvalue()), len(out.getvalue()))
    with pytest.raises(ValueError):
        p.read("a")


def test_shards(spark):
    rows = [(i, f"text {i} " * (i % 9 + 1)) for i in range(3000)] + [(5000 + i, "hot copy") for i in range(1500)] + [(None, None), (7, "text 7 "), (9000, "long " * 2000)] + [(9100 + i, "heavy " * 700) for i in range(8)]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "doc_id long, text string, shard int, size int")
    got = binpack.shards(df, 16).collect()
    assert sorted(((r.size, r.text_crc32) for r in got)) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    by, groups = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        groups[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    sizes = [sum(r.size for r in v) for v in by.values()]
    counts = [len(v) for v in by.values()]
    assert set(by) <= set(range(16)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert max(sizes) <= 1.15 * sum(sizes) / 16 and max(counts) < 1.35 * len(rows) / 16
    hot = zlib.crc32(b"hot copy")
    assert all(len(s) == 1 for c, s in groups.items() if c not in (hot, zlib.crc32(b"heavy " * 700))) and len(groups[hot]) > 4
    assert binpack.shards(df.limit(0), 16).collect() == []


def test_shards_balance_on_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = binpack.shards(d, 4).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert max(sizes) < 1.05 * sum(sizes) / 4


def plain_place(items, left):
    """Largest first; highest dot product among the shards with room, else the least overrun."""
    left, out = [list(x) for x in left], {}
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i]), -sum(items[i]), i)):
        room = [s for s, x in enumerate(left) if all(a >= b for a, b in zip(x, items[i], strict=True))]
        if room:
            s = max(room, key=lambda s: (sum(a * b for a, b in zip(left[s], items[i], strict=True)), -s))
        else:
            s = max(range(len(left)), key=lambda s: (min(a - b for a, b in zip(left[s], items[i], strict=True)), -s))
        out[i] = s
        left[s] = [a - b for a, b in zip(left[s], items[i], strict=True)]
    return [out[i] for i in range(len(items))]


def test_placement_is_by_dot_product():
    items = np.array([[0.5, 0.1], [0.1, 0.5], [0.4, 0.4], [0.0, 0.0]])
    assert binpack.place(items, np.full((2, 2), 0.5))[:2] == [0, 1]
    r = np.random.default_rng(5)
    for n in (0, 1, 40, 300):
        items = r.integers(0, 64, (n, 3)) / 1024.0  # sums of these are exact
        left = np.full((16, 3), items.sum(axis=0).max(initial=0) / 16)
        want = plain_place(items.tolist(), left.tolist())
        assert binpack.place(items, left) == want


def test_every_group_is_placed_by_itself(spark, monkeypatch):
    """With all groups light and one part, shards are those of a plain placement of the groups."""
    r = np.random.default_rng(8)
    texts = ["".join(r.choice(list("ab ")) for _ in range(r.integers(1, 60))) for _ in range(200)]
    rows = [(k, texts[k % len(texts)] if k % 3 else texts[0]) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(binpack, "HEAVY", 1)  # no group holds all
    got = binpack.shards(df, 4).collect()
    shard = {}
    for x in got:
        shard.setdefault(x.text_crc32, set()).add(x.shard)
    assert all(len(s) == 1 for s in shard.values())
    groups = {}
    for g, t in df.selectExpr("xxhash64(text) g", "text").collect():
        b, n, k, _ = groups.get(g, (0, 0, 0, t))
        groups[g] = (b + len(t.encode()) + 1, n + len(t.split()), k + 1, t)
    order = sorted(groups)
    items = np.array([groups[g][:3] for g in order], dtype=float)
    items = items / items.sum(axis=0)
    want = plain_place(items.tolist(), [[0.25] * 3] * 4)
    assert [shard[zlib.crc32(groups[g][3].encode())] for g in order] == [{s} for s in want]


def test_parts_of_groups_balance(spark, monkeypatch):
    monkeypatch.setattr(binpack, "PART_GROUPS", 500)
    df = spark.createDataFrame([(k, f"text {k} " * (k * 7919 % 13 + 1)) for k in range(6000)], "doc_id long, text string")
    got = binpack.shards(df, 16).collect()
    sizes, counts, slots = defaultdict(int), defaultdict(int), defaultdict(list)
    for x in got:
        sizes[x.shard] += x.size
        counts[x.shard] += 1
        slots[x.shard].append(x.slot)
    assert len(got) == 6000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 16 and max(counts.values()) < 1.03 * 6000 / 16


def test_checkpoint_folder_is_taken_from_the_session(spark):
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert C.shared_root(spark) == (conf.rstrip("/") if conf else f"file:///tmp/quarrion-shared-{os.getuid()}")
