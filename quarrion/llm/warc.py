"""WARC in ZIP packages: write records into stored members, and read them by range.

A package is a ZIP file whose members are stored (uncompressed): archive/data.warc.gz, a
gzip member a record, and indexes/index.cdxj, a line a record: sort key, time, and a JSON object with the
record's file, offset and length. The reader parses the end record, the ZIP64 end record and locator, the
central directory with ZIP64 extra fields, and the local header of a member, and then fetches
single records by range; nothing is extracted. It takes packages of others, too: indexes as .cdxj,
.cdx or, in gzip, .cdx.gz, also if the ZIP file compresses them, and archives whose records are plain or gzip members.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C

PIECE = 1 << 20
#: The mandatory date of records whose pages have none.
DATE = "1970-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: ZIP signatures, and the values that stand for "see the ZIP64 field" (fixed by the format).
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class Package:
    """Random access to a ZIP file; source: seek and read."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        tail_n = min(size, 22 + FULL16)
        tail = self._at(size - tail_n, tail_n)
        k = tail.rfind(END)
        while k >= 0 and (k + 22 > tail_n or k + 22 + struct.unpack("<H", tail[k + 20 : k + 22])[0] != tail_n):
            k = tail.rfind(END, 0, k + 3)  # these bytes are part of the comment
        if k < 0:
            raise ValueError("no end of central directory")
        n, length, at = struct.unpack("<HII", tail[k + 10 : k + 20])
        where = size - tail_n + k - 20
        if where >= 0 and (head := self._at(where, 20))[:4] == LOCATOR:
            at64 = struct.unpack("<Q", head[8:16])[0]
            record = self._at(at64, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, at = struct.unpack("<QQQ", record[32:56])
        elif FULL32 in (length, at):  # FULL16 members may be just that many
            raise ValueError("ZIP64 locator is missing")
        self.members: dict[str, tuple[int, int, int]] = dict(self._central(self._at(at, length), n))
        self.begin: dict[str, int] = {}

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    @staticmethod
    def _central(data: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """(name, (method, stored bytes, local header's place))"""
        k = 0
        for _ in range(n):
            if data[k : k + 4] != CENTRAL:
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack("<HH", data[k + 8 : k + 12])
            stored, whole, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[k + 20 : k + 34])
            at = struct.unpack("<I", data[k + 42 : k + 46])[0]
            name = data[k + 46 : k + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[k + 46 + n_name :][:n_extra]
            while len(extra) >= 4:
                kind, m = struct.unpack("<HH", extra[:4])
                if kind == 1:  # 64-bit values of those fields that are full, in this order
                    full = [whole == FULL32, stored == FULL32, at == FULL32]
                    if min(m, len(extra) - 4) < 8 * sum(full):
                        raise ValueError("ZIP64 extra field is damaged")
                    wide = iter(struct.unpack(f"<{sum(full)}Q", extra[4 : 4 + 8 * sum(full)]))
                    whole, stored, at = (next(wide) if f else x for f, x in zip(full, (whole, stored, at), strict=True))
                extra = extra[4 + m :]
            yield name, (method, stored, at)
            k += 46 + n_name + n_extra + n_note

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        """n bytes of a stored member from offset."""
        method, stored, at = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        if name not in self.begin:
            head = self._at(at, 30)
            if head[:4] != LOCAL:
                raise ValueError("no local header")
            self.begin[name] = at + 30 + sum(struct.unpack("<HH", head[26:30]))
        n = stored - offset if n is None else min(n, stored - offset)
        return self._at(self.begin[name] + offset, n)

    def _member(self, name: str) -> Iterator[bytes]:
        """The whole of a stored or deflated member, in pieces."""
        method, stored, at = self.members[name]
        head = self._at(at, 30)
        begin = at + 30 + sum(struct.unpack("<HH", head[26:30]))
        unzip = zlib.decompressobj(-15) if method == 8 else None
        if method not in (0, 8):
            raise ValueError(f"{name} has compression method {method}")
        for k in range(0, stored, PIECE):
            data = self._at(begin + k, min(PIECE, stored - k))
            yield unzip.decompress(data) if unzip else data

    def indexes(self) -> Iterator[dict]:
        """Each index line's object, with file (a member's name), offset and length; a line may begin with a key and a time."""
        for name in self.members:
            if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdx.gz")):
                pieces, rest = self._member(name), b""
                for data in _gunzipped(pieces) if name.endswith(".gz") else pieces:
                    *lines, rest = (rest + data).split(b"\n")
                    yield from filter(None, map(self._entry, lines))
                if entry := self._entry(rest):
                    yield entry

    def _entry(self, line: bytes) -> dict | None:
        k = line.find(b"{")
        if k < 0 or line.startswith(b"!"):  # a blank line or the header
            return None
        x = json.loads(line[k:])
        file = x.get("file") or x["filename"]
        file = file if file in self.members else f"archive/{file}"
        return x | {"file": file, "offset": int(x["offset"]), "length": int(x["length"])}

    def record(self, entry: dict) -> tuple[dict[str, str], bytes]:
        """(headers, block) of the record that an index line names."""
        data = self.read(entry["file"], entry["offset"], entry["length"])
        if data[:2] == b"\x1f\x8b":
            data = zlib.decompress(data, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record there")
        fields = dict(re.split(r":[ \t]*", x, maxsplit=1) for x in lines[1:])
        return fields, rest[: int(fields["Content-Length"])]


def _gunzipped(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of gzip members that follow one another."""
    unzip = zlib.decompressobj(31)
    for data in pieces:
        while data:
            yield unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def open_package(uri: str) -> Package:
    fs, path = C.file_system(uri)
    return Package(fs.open_input_file(path), fs.get_file_info(path).size)


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def sort_key(url: str | None) -> str:
    """The key of an index line: the host's labels in reverse, then the path; blanks are escaped."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", "".join(f"%{ord(c):02X}" if c <= " " else c for c in (url or "").lower()))
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.split('.')))}){slash}{path}"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A gzip member with a response, or, where refers_to is given, a revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    block = http + (payload if refers_to is None else b"")
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items())
    zip_ = zlib.compressobj(1, zlib.DEFLATED, 31)
    return zip_.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + zip_.flush()


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write a package a partition; returns the manifest (path, n_records), materialised.

    Only keys are aggregated to find each payload's response: its digest and largest page_id. A payload that many pages
    share is dealt over pieces when they're joined.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("_d", F.unhex(F.sha1("html")))
    last = C.cut(p.groupBy("_d").agg(F.max("page_id").alias("_last"), F.count("*").alias("n")), "payloads")
    limit = C.hot_limit(last.agg(F.sum("n")).first()[0] or 0)
    p = C.salted_join(p, last.drop("n"), "_d", last.where(F.col("n") > limit).select("_d", "n"))
    p = p.select("page_id", "url", "html", F.when(F.col("page_id") == F.col("_last"), F.lit(None)).otherwise(F.col("_last")).alias("refers"))
    shape = "path string, n_records long"
    schema = C.arrow(shape)

    def write(batches):
        uri, lines, at = f"{folder}/pages-{TaskContext.get().partitionId():06d}.wacz", [], 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if (first := next(rows, None)) is None:
            return
        with C.atomic_file(uri) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA, "w", force_zip64=True) as member:
                for page_id, url, html, refers in chain([first], rows):
                    payload = html.encode()
                    data = record_bytes(page_id, url, payload, sha1_32(payload), refers)
                    member.write(data)
                    about = {"url": url or "", "digest": f"sha1:{sha1_32(payload)}", "length": str(len(data)), "offset": str(at), "filename": DATA.rpartition("/")[2], "id": page_id}
                    lines.append(f"{sort_key(url)} {DATE.translate({45: None, 58: None, 84: None, 90: None})} {json.dumps(about)}")
                    at += len(data)
            package.writestr(INDEX, "\n".join(sorted(lines)) + "\n")
        yield pa.RecordBatch.from_pydict({"path": [uri], "n_records": [len(lines)]}, schema)

    return C.cut(p.mapInArrow(write, shape), "packages")


def read_packages(manifest: DataFrame, verify: bool = True) -> DataFrame:
    """A row a record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest come from its payload (which must match its header);
    a revisit's from its headers, as its payload is its response's.
    """
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema = C.arrow(shape)

    def number(urn: str | None) -> int | None:
        return int(x) if urn and (x := urn[len("<urn:page:") : -1]) != "None" else None

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                package, rows = open_package(uri), []
                for entry in package.indexes():
                    head, block = package.record(entry)
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n = len(payload)
                        if verify and sha1_32(payload) != digest:
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    else:
                        n = int(head["X-Payload-Length"])
                    rows.append((number(head["WARC-Record-ID"]), n, digest, kind, number(head.get("WARC-Refers-To"))))
                    if len(rows) == 10_000:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return C.a_task_each(manifest.select("path"), "path").mapInArrow(read, shape)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html) as packages and read them back.

    Null html: an empty payload. Of equal payloads the largest page_id is the response; a
    repeated row of that page_id is a response too. A null page_id compares as smallest:
    its record revisits the response, or is one if no page of that payload has an id.
    Null urls give an empty target. An empty table gives no package and no rows. Other columns, and any that
    have the result's names, aren't read.
    """
    return read_packages(write_packages(pages, folder or C.fresh_folder(pages.sparkSession, "packages")))
