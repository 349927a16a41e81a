import datetime

from pyspark.sql import functions as F

from quarrion.sources import chunk, upkeep
from quarrion.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
EVENT = "path string, type string, ts timestamp, text string, language string, parser string"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def drained(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_incremental_index(spark, tmp_path):
    """What the stream leaves equals one batch over the final state; a replay changes nothing."""
    md = lambda p, k, s, text: (p, k, at(s), text, None, "markdown")
    batches = [[md("a.md", "add", 1, "# A\none"), md("b.md", "add", 1, "# B\ntwo")], [md("a.md", "change", 3, "# A\nnew"), md("a.md", "change", 2, "# A\nmid"), md("b.md", "unlink", 4, None)], [md("c.md", "add", 5, "# C\nthree"), md("a.md", "change", 6, "# A\nnew")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _ = i
    store = upkeep.Store(spark, f"file://{tmp_path}/store")
    final = spark.createDataFrame([md("a.md", "add", 1, "# A\nnew"), md("c.md", "add", 1, "# C\nthree")], EVENT)
    chunks = chunk.chunked(final)
    store.commit({"files": spark.createDataFrame([], "path string, hash string"), "chunks": chunks.limit(0)})
    for _ in range(2):
        q = jobs.index_events(stream(spark, tmp_path / "in", EVENT), store, chunk.chunked, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.id for r in store.read("chunks").collect()) == sorted(r.id for r in chunks.collect())
    assert {r.path for r in store.read("files").collect()} == {"a.md", "c.md"}


def planned(events, most, seconds, quiet):
    """What is to be done, by a list of events in order."""
    out, begin, inside, bulk, last = [], None, {}, False, None
    for t, path, kind in [*sorted(events), (10**9, None, None)]:
        if bulk and t - last > quiet:
            out += [("replay", p, k) for p, k in sorted(inside.items())]
            begin, bulk = None, False
        if path is None:
            break
        if not bulk and (begin is None or t - begin > seconds):
            begin, count, inside = t, 0, {}
        inside[path], last = kind, t
        count += 1
        if not bulk:
            bulk = count == most
            out.append(("bulk", None, None) if bulk else ("apply", path, kind))
    return out


def test_bursts(spark, tmp_path):
    """Bursts, what is held and replayed, and quiet times, of events out of order over several batches."""
    import random

    r = random.Random(3)
    events = {"w": [(k * 0.05, f"p{r.randint(0, 6)}", r.choice(["add", "change", "unlink"])) for k in range(60)] + [(60 + 2.0 * k, f"q{k}", "change") for k in range(9)] + [(120 + k * 0.1, "z", "change") for k in range(25)], "x": [(float(k), f"p{k}", "add") for k in range(12)]}
    rows = [(src, p, k, at(t)) for src, some in events.items() for t, p, k in some]
    rows = sorted(rows, key=lambda x: x[3])
    shape = "source string, path string, type string, ts timestamp"
    for k in range(3):  # within a batch in any order; the last event moves the watermark beyond all
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3] + ([("end", "e", "add", at(1000))] if k == 2 else [])
        r.shuffle(part)
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.bursts(stream(spark, tmp_path / "in", shape), 20, 5, 2, "10 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    drained(q)
    got = {}
    for x in spark.table("bursts").collect():
        got.setdefault(x.source, []).append((x.action, x.path, x.type))
    for src, some in events.items():
        want = planned([(round(t, 3), p, k) for t, p, k in some], 20, 5, 2)
        assert got[src] == want, src
    assert sum(x[0] == "bulk" for x in got["w"]) == 2 and ("replay", "z", "change") in got["w"] and all(x[0] == "apply" for x in got["x"])


def test_debounce_and_sends(spark, tmp_path):
    rows = [("a", "add", at(0)), ("a", "change", at(0.2)), ("a", "change", at(5)), ("b", "add", at(0)), ("z", "add", at(600))]
    spark.createDataFrame(rows, "path string, type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream(spark, tmp_path / "in", "path string, type string, ts timestamp")
    drained(jobs.debounced(s).writeStream.format("memory").queryName("debounced").outputMode("append").start())
    assert sorted((r.path, r.type, r["at"]) for r in spark.table("debounced").collect()) == [("a", "change", at(0.2)), ("a", "change", at(5)), ("b", "add", at(0))]
    sent = s.select(F.col("path").alias("hash"), "ts")
    drained(jobs.unsent(sent).writeStream.format("memory").queryName("sent").outputMode("append").start())
    assert sorted(r.hash for r in spark.table("sent").collect()) == ["a", "b", "z"]


def test_read_feedback(spark, tmp_path):
    shape = "id long, key string, ts timestamp"
    spark.createDataFrame([(1, "f", at(0)), (2, "g", at(0))], shape).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(7, "f", at(60)), (8, "f", at(900)), (9, "g", at(-1))], shape).write.parquet(str(tmp_path / "d"))
    q = jobs.read_feedback(stream(spark, tmp_path / "r", shape), stream(spark, tmp_path / "d", shape))
    drained(q.writeStream.format("memory").queryName("fb").outputMode("append").start())
    assert [tuple(r) for r in spark.table("fb").collect()] == [(1, 7)]


def sends(rows, ttl, most):
    """(hash, time, sent) of one session's uses (time, hash, whole), by a list of marks."""
    marks, out = [], []
    for t, h, whole in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2])):
        if h is None:
            marks = []
            continue
        seen = any(m == h and t - at_ <= ttl for m, at_ in marks)
        out.append((h, t, seen))
        if whole or not seen:
            marks = [m for m in marks if m[0] != h]
            marks = [*(marks[1:] if len(marks) >= most else marks), (h, t)]
    return out


def test_sent_registry(spark, tmp_path):
    """Times to live, eviction, marks made anew, forgetting, ties and repeated rows, of rows out of order over several batches."""
    import random

    r = random.Random(8)
    uses = {f"s{k}": [(r.randrange(0, 400_000, 500) / 1000, None if r.random() < 0.02 else f"h{r.randint(0, 11)}", r.random() < 0.2) for _ in range(150)] for k in range(3)}
    uses["s0"] += uses["s0"][:20]
    uses["quiet"] = [(1.0, "a", False), (2.0, "a", False), (61.0, "a", False), (61.001, "b", False), (121.002, "a", True)]
    shape = "session string, hash string, ts timestamp, whole boolean"
    rows = sorted(((s, h, at(t), w) for s, some in uses.items() for t, h, w in some), key=lambda x: x[2])
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4] + ([("end", "e", at(2000), False)] if k == 3 else [])
        r.shuffle(part)
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.sent(stream(spark, tmp_path / "in", shape), 60, 5).writeStream.format("memory").queryName("sent_registry").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    drained(q)
    got = {}
    for x in spark.table("sent_registry").collect():
        got.setdefault(x.session, []).append((x.hash, (x.ts - T0).total_seconds(), x.sent))
    for s, some in uses.items():
        assert sorted(got[s]) == sorted(sends(some, 60, 5)), s
    assert [x[2] for x in sorted(got["quiet"], key=lambda x: x[1])] == [False, True, True, False, False]
    assert {x[2] for x in got["s0"]} == {True, False}
