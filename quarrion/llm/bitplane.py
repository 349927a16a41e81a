"""Token-id files of bit-plane shuffled blocks, and the operator that writes and reads them.

A file is: magic; blocks; document index; chunk index; footer. A block holds up to BLOCK ids.
Its ids, seen as a matrix of rows (ids) and columns (bytes, or bits), are transposed, and
each column (plane) is compressed by zstandard on its own. The chunk index gives each
plane's place, length and checksum, so that a range of ids is read without the rest.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.llm import common as C
from quarrion.llm.encode import SLICE, encoder

MAGIC = b"QPLANES1"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QQQQQQ8s")


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte (4) or bit (32) planes of little-endian unsigned 32-bit ids."""
    cells = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        cells = np.empty((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            cells[:, k] = np.frombuffer(p, dtype=np.uint8)
        return cells.reshape(-1).view("<u4")
    bits = np.empty((n, 32), dtype=np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Appends documents' ids to one file; holds one block and the indexes."""

    def __init__(self, out, kind: str = "byte", level: int = 1):
        self.out, self.kind, self.zip = out, kind, zstandard.ZstdCompressor(level=level)
        self.at = self.out.write(MAGIC) or len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.notes: list[str | None] = []
        self.chunks: list[dict] = []

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, notes: list[str | None] | None = None) -> None:
        """Documents with their numbers of ids, and all their ids one after another; doc_ids may be null; notes are kept with them."""
        self.docs += doc_ids
        self.lengths += lengths.tolist()
        self.notes += notes or [None] * len(doc_ids)
        self.held.append(np.ascontiguousarray(ids, "<u4"))
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate([np.zeros(0, "<u4"), *self.held])
        end = len(ids) if all_ else len(ids) - len(ids) % BLOCK
        for k in range(0, end, BLOCK):
            part, places = ids[k : min(k + BLOCK, end)], []
            for plane in planes_of(part, self.kind):
                data = self.zip.compress(plane)
                places.append([self.at, len(data), zlib.crc32(data)])
                self.out.write(data)
                self.at += len(data)
            self.chunks.append({"n": len(part), "planes": places})
        self.n_ids += end
        self.held, self.n_held = [ids[end:].copy()], len(ids) - end

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        self._flush(True)
        docs = self.zip.compress(json.dumps([self.docs, self.lengths, self.notes if any(x is not None for x in self.notes) else None]).encode())
        chunks = self.zip.compress(json.dumps({"kind": self.kind, "block": BLOCK, "chunks": self.chunks}).encode())
        self.out.write(docs + chunks + FOOTER.pack(self.at, len(docs), self.at + len(docs), len(chunks), len(self.docs), self.n_ids, MAGIC))
        return len(self.docs), self.n_ids


class Reader:
    """Range reads of a file; source: an open file with seek and read."""

    def __init__(self, source, size: int):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        docs_at, docs_n, at, n, self.n_docs, self.n_ids, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        index = json.loads(self.unzip.decompress(self._bytes(at, n)))
        self.kind, self.block, self.chunks = index["kind"], index["block"], index["chunks"]
        self.docs, self.lengths, self.notes = json.loads(self.unzip.decompress(self._bytes(docs_at, docs_n)))

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        planes = []
        for at, n, crc in self.chunks[k]["planes"]:
            data = self._bytes(at, n)
            if zlib.crc32(data) != crc:
                raise ValueError(f"chunk {k} is damaged")
            planes.append(self.unzip.decompress(data))
        return ids_of(planes, self.chunks[k]["n"], self.kind)

    def read(self, start: int, n: int) -> np.ndarray:
        """ids start to start + n, from the chunks that hold them alone."""
        if n == 0:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        got = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return got[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray, str | None]]:
        """(doc_id, start in the file, ids, note), each chunk read once."""
        held, base, k, start = np.empty(0, "<u4"), 0, 0, 0
        for i, (doc, n) in enumerate(zip(self.docs, self.lengths, strict=True)):
            if start + n > base + len(held):
                parts = [held[start - base :]]
                have = len(parts[0])
                while have < n:
                    parts.append(self.chunk(k))
                    have += len(parts[-1])
                    k += 1
                held, base = np.concatenate(parts), start
            yield doc, start, held[start - base :][:n], self.notes[i] if self.notes else None
            start += n


def open_file(uri: str):
    fs, path = C.file_system(uri)
    return Reader(fs.open_input_file(path), fs.get_file_info(path).size)


def encode_batches(batches, path: str | None, end_id: int, special_as_text: bool = False):
    """(columns without the text, ids of all rows with their end ids, number of each) of slices of batches whose second column is the text."""
    with encoder(path, special_as_text) as coder:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for s in C.slices(sizes, sizes, SLICE):
                part = batch.slice(s.start, s.stop - s.start)
                ids, counts = coder.encode(part.column(1), end_id)
                yield [part.column(k).to_pylist() for k in range(part.num_columns) if k != 1], ids, counts
                del ids, counts
            pa.default_memory_pool().release_unused()


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, kind: str = "byte", special_as_text: bool = False) -> DataFrame:
    """Encode documents(doc_id, text) and write a file a partition of ascending doc_id.

    Returns the manifest (part, path, n_docs, n_ids), materialised in the shared folder.
    Null text: empty, so the end id alone. Rows with a null doc_id come first, and repeated
    rows lie side by side. An empty table gives no file. Equal ids are told apart by the
    text's hash and the row's place, so that no id, however frequent, makes one task long.
    """
    d = docs.select("doc_id", C.text_of().alias("text")).withColumn("_h", F.xxhash64("text")).withColumn("_i", F.monotonically_increasing_id())
    d = d.repartitionByRange("doc_id", "_h", "_i").sortWithinPartitions("doc_id", "_h", "_i").select("doc_id", "text")

    def write(batches):
        part, slices = TaskContext.get().partitionId(), encode_batches(batches, tokenizer, end_id, special_as_text)
        if (first := next(slices, None)) is None:
            return
        uri = f"{folder}/ids-{part:06d}.qpl"
        with C.atomic_file(uri) as out:
            w = Writer(out, kind)
            for (doc_ids,), ids, counts in chain([first], slices):
                w.add(doc_ids, counts, ids)
            n_docs, n_ids = w.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "n_docs": [n_docs], "n_ids": [n_ids]}, schema)

    shape = "part long, path string, n_docs long, n_ids long"
    schema = C.arrow(shape)
    return C.cut(d.mapInArrow(write, shape), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row a file, as many as the writing job had tasks; their starts are summed in order.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = C.cut(manifest.select("path", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("start")), "starts")
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema = C.arrow(shape)

    def read(batches):
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc, at, ids, _ in open_file(uri).documents():
                    rows.append((doc, base + at, len(ids), zlib.crc32(ids)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return C.a_task_each(starts, "part").select("path", "start").mapInArrow(read, shape)


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0, kind: str = "byte", special_as_text: bool = False) -> DataFrame:
    """Write documents(doc_id, text) as bit-plane files under folder (default: a new one in the shared folder) and read them back.

    Rows as in write_ids and read_ids. Strings of special tokens in a text are encoded as the library does by default, so as
    those tokens; special_as_text makes them ordinary text. Other columns, whatever their names, aren't read.
    """
    folder = folder or C.fresh_folder(docs.sparkSession, "token-files")
    return read_ids(write_ids(docs, folder, tokenizer, end_id, kind, special_as_text))
