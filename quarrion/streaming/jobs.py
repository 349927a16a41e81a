"""Streams: incremental indexing from file events, bursts, debouncing, duplicate sends, and read feedback."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarrion.operators import fulltext, memory
from quarrion.sources import upkeep

BURST, BURST_SECONDS = 100, 5


def index_events(events: DataFrame, store: upkeep.Store, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict | None = None, index: bool = False):
    """Apply file events(path, type add|change|unlink, ts, text, language, parser) to the store's tables files and chunks.

    Of a path's events in a batch the last holds; unchanged content is skipped; a batch that is run again changes nothing, because
    rows are keyed. Ordering within a path is by ts. A batch reads one snapshot; if another writer changed the tables meanwhile, it starts anew
    from theirs. index: keep the full-text segments up to date, too: a batch adds a segment, and nothing of the others is rewritten but by
    merges. On a fresh store both tables begin empty.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = upkeep.latest(batch, "path", "ts", "type").persist()
        try:
            if last.isEmpty():
                return

            def tables(s: upkeep.Snapshot) -> dict[str, DataFrame]:
                gone = last.where("type = 'unlink'").select("path")
                new = last.where("type <> 'unlink'").withColumn("hash", F.sha2("text", 256))
                fresh = new if "files" not in s.tables else new.join(s.read("files").select("path", "hash"), ["path", "hash"], "left_anti")
                touched = gone.unionByName(fresh.select("path"))
                chunks = chunker(fresh)
                if "files" not in s.tables:
                    return {"files": fresh.select("path", "hash", *(c for c in ("language", "parser") if c in fresh.columns)), "chunks": chunks}
                files, old = s.read("files"), s.read("chunks")
                return {
                    "files": upkeep.removed(files, touched, "path").unionByName(fresh.select(*files.columns)),
                    "chunks": upkeep.removed(old, touched.withColumnRenamed("path", "source_file"), "source_file").unionByName(chunks.select(*old.columns)),
                }

            store.update(tables)
        finally:
            last.unpersist()

    def apply_with_index(batch: DataFrame, k: int) -> None:
        last = upkeep.latest(batch, "path", "ts", "type").persist()
        try:
            if not last.isEmpty():
                new = last.where("type <> 'unlink'").withColumn("hash", F.sha2("text", 256))
                fulltext.apply(store, last.where("type = 'unlink'").select(F.col("path").alias("source_file")), new, chunker, (checkpoint, k))
                fulltext.merge(store)
        finally:
            last.unpersist()

    w = events.writeStream.foreachBatch(apply_with_index if index else apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


BURST_SHAPE = "source string, action string, path string, type string, at timestamp"


class _Bursts(StatefulProcessor):
    """Event by event in order of time, once the watermark has passed them; see bursts()."""

    def __init__(self, most: int, seconds: int, quiet: int):
        self.most, self.window, self.quiet = most, seconds * 1000, quiet * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, path string, type string", "n long")
        self.now = handle.getValueState("now", "begin long, n long, bulk boolean, last long")
        self.held = handle.getMapState("held", "path string", "type string, at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for pdf in rows:
            for t, path, kind in zip(pdf["ts"], pdf["path"], pdf["type"], strict=True):
                row = int(t.timestamp() * 1000), path, kind
                n = self.waiting.getValue(row)[0] if self.waiting.containsKey(row) else 0
                self.waiting.updateValue(row, (n + 1,))
                self.handle.registerTimer(row[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        due, out = timerValues.getCurrentWatermarkInMs(), []  # all up to here have come
        begin, n, bulk, last = self.now.get() if self.now.exists() else (None, 0, False, 0)
        rows = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= due)

        def replay():
            out.extend((path, "replay", kind, last + self.quiet) for path, (kind, _) in sorted((k[0], tuple(v)) for k, v in list(self.held.iterator())))
            self.held.clear()

        for (at, path, kind), times in rows:
            self.waiting.removeKey((at, path, kind))
            for _ in range(times):
                if bulk and at - last > self.quiet:
                    replay()
                    begin, n, bulk = None, 0, False
                if not bulk and (begin is None or at - begin > self.window):
                    begin, n = at, 0
                    self.held.clear()
                n, last = n + 1, at
                self.held.updateValue((path,), (kind, at))  # of the events of a window, and of the burst, each path's last
                if bulk:
                    continue
                if n < self.most:
                    out.append((path, "apply", kind, at))
                else:
                    bulk = True
                    out.append((None, "bulk", None, at))
        if bulk and due - last > self.quiet:
            replay()
            begin, n, bulk = None, 0, False
        elif bulk:
            self.handle.registerTimer(last + self.quiet + 1)
        self.now.update((begin, n, bulk, last))
        if out:
            times = pd.to_datetime([x[3] for x in out], unit="ms", utc=True)
            yield pd.DataFrame({"source": [key[0]] * len(out), "action": [x[1] for x in out], "path": [x[0] for x in out], "type": [x[2] for x in out], "at": times})

    def close(self) -> None:
        pass


def bursts(events: DataFrame, most: int = BURST, seconds: int = BURST_SECONDS, quiet: int = 2, delay: str = "10 seconds") -> DataFrame:
    """(source, action, path, type, at) of a stream of file events(source, path, type, ts): what is to be done.

    apply: index the event's file. bulk: `most` events came within `seconds` of a window's first, so everything is indexed anew; what comes after is
    held until no event has come for `quiet` seconds. Then, replay: the last state of each path of the window and the burst, in order of path, so that neither
    queued old work nor what the bulk pass saw too early wins. A window begins with the first event later than `seconds` after the last one's begin, or
    after a burst. Events take effect in order of time (ties: path, type), when the watermark has passed them; later ones than `delay` are dropped. A source's
    events pass through one state, whose size is the paths of a burst and the events of the delay. Needs the RocksDB state store, which is set if none is.
    """
    _with_map_state(events.sparkSession)
    return events.withWatermark("ts", delay).groupBy("source").transformWithStateInPandas(_Bursts(most, seconds, quiet), BURST_SHAPE, "Append", "EventTime")


def debounced(events: DataFrame, gap: str = "400 milliseconds", delay: str = "1 minute") -> DataFrame:
    """(path, type, at): the last event of each run of a path's events without a pause of `gap`."""
    w = events.withWatermark("ts", delay).groupBy("path", F.session_window("ts", gap))
    return w.agg(F.max_by("type", "ts").alias("type"), F.max("ts").alias("at")).select("path", "type", "at")


def unsent(chunks: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """Chunks(hash, ts) whose hash wasn't sent within the time before. State is bounded by the watermark."""
    return chunks.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["hash"])


SENT_SHAPE = "session string, hash string, ts timestamp, sent boolean"


class _Sent(StatefulProcessor):
    """Row by row in order of time, once the watermark has passed them; see sent()."""

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, hash string, whole boolean", "n long")
        self.held = handle.getMapState("held", "hash string", "at long, turn long")
        self.turn = handle.getValueState("turn", "turn long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        due = set()
        for pdf in rows:
            for t, hash_, whole in zip(pdf["ts"], pdf["hash"], pdf["whole"], strict=True):
                row = int(t.timestamp() * 1000), None if pd.isna(hash_) else hash_, bool(whole) and not pd.isna(whole)
                n = self.waiting.getValue(row)[0] if self.waiting.containsKey(row) else 0
                self.waiting.updateValue(row, (n + 1,))
                due.add((row[0] // 1000 + 1) * 1000)
        for at in due:  # one a second
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= now), key=lambda r: (r[0][0], r[0][1] is not None, r[0][1] or "", r[0][2]))
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        held = dict(sorted(before.items(), key=lambda x: x[1][1]))  # the longest unmarked first; `most` at most
        turn, out = self.turn.get()[0] if self.turn.exists() else 0, []
        for (at, hash_, whole), times in rows:
            self.waiting.removeKey((at, hash_, whole))
            if hash_ is None:
                held.clear()
                continue
            for _ in range(times):
                sent = hash_ in held and at - held[hash_][0] <= self.ttl
                out.append((hash_, at, sent))
                if whole or not sent:
                    held.pop(hash_, None)
                    if len(held) >= self.most:
                        del held[next(iter(held))]
                    turn += 1
                    held[hash_] = at, turn
        live = {h: v for h, v in held.items() if now - v[0] <= self.ttl}
        for h in before.keys() - live.keys():
            self.held.removeKey((h,))
        for h, v in live.items():
            if before.get(h) != v:
                self.held.updateValue((h,), v)
        if live:
            self.turn.update((turn,))
            self.handle.registerTimer(max(at for at, _ in live.values()) + self.ttl + 1)
        elif self.turn.exists():
            self.turn.clear()  # a session that has been quiet leaves nothing
        if out:
            times = pd.to_datetime([x[1] for x in out], unit="ms", utc=True)
            yield pd.DataFrame({"session": [key[0]] * len(out), "hash": [x[0] for x in out], "ts": times, "sent": [x[2] for x in out]})

    def close(self) -> None:
        pass


def sent(events: DataFrame, ttl: int = 900, most: int = 200, delay: str = "10 seconds") -> DataFrame:
    """(session, hash, ts, sent) of a stream of uses(session, hash, ts, whole): whether the chunk was sent before, so that a stub will do.

    A chunk counts as sent for `ttl` seconds from its mark, while it's among the `most` last marked of its session. It is marked when it wasn't sent before, or
    when it goes out in whole anyway. A null hash forgets all that the session was sent (files have changed). Rows take effect in order of time (ties:
    forgetting first, then by hash, stubs before whole ones) when the watermark has passed them; those later than `delay` are dropped. A session's state is `most` marks and
    the rows of the delay; it's empty again `ttl` seconds after the last mark. Needs the RocksDB state store, which is set if none is.
    """
    _with_map_state(events.sparkSession)
    return events.withWatermark("ts", delay).groupBy("session").transformWithStateInPandas(_Sent(ttl, most), SENT_SHAPE, "Append", "EventTime")


def _with_map_state(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_feedback(retrieved: DataFrame, reads: DataFrame, delay: str = "1 minute") -> DataFrame:
    """memory.read_feedback on two streams, whose state the watermarks bound."""
    return memory.read_feedback(retrieved.withWatermark("ts", delay), reads.withWatermark("ts", delay))


def replayed(buffered: DataFrame, most: int = 10_000) -> tuple[bool, DataFrame]:
    """(bulk, events) of file events that came in during the first index: the last of each path, to be applied after it; or, if
    there were more than `most`, none, and the whole is to be indexed again."""
    if buffered.limit(most + 1).count() > most:
        return True, buffered.limit(0)
    return False, upkeep.latest(buffered, "path", "ts", "type")


def prune(store: upkeep.Store, as_of: Column, prompts: int = 5000, events: int = 20_000, days: int = 30) -> int:
    """Commit a version without prompts and events that are too old or too many."""
    keep = lambda s, name, n: memory.retained(s.read(name), as_of, days * memory.DAY, n)
    return store.update(lambda s: {"prompts": keep(s, "prompts", prompts), "events": keep(s, "events", events)})


def decay(store: upkeep.Store, as_of: Column) -> int:
    """Commit a version of the facts in which confidence has faded."""
    return store.update(lambda s: {"facts": memory.decayed(s.read("facts"), as_of)})


def every(spark: SparkSession, interval: str, job: Callable[[], object], checkpoint: str):
    """Run a job again and again, as a stream whose batches hold nothing else."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda *_: job()).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
