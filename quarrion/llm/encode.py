"""Whole-text BPE encoding with the tokenizers library, made cheap by remembering pieces.

A byte-level BPE of this kind first cuts a text by a fixed pattern, in which only a blank's own alternative
and the leading space of a word hold blanks. After a character that isn't blank, no match runs on into
a blank, and the pattern never looks back; so a blank after a character that isn't one is always a boundary.
Texts are cut there, each distinct piece of a batch is looked up once, unknown ones go to the library,
and the ids are gathered from one buffer. A file whose parts don't promise this (another pre-tokenizer,
a normalizer, padding) has its texts encoded whole, as are texts that hold an added token's string.
The result equals encoding each whole text by the library with its own defaults; a test holds the two
against each other.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import threading
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, some 60 bytes each; when full, it forgets those that it met in one slice only, and if that isn't half, all.
CACHE_PIECES = 800_000
#: Longer pieces (bytes) aren't remembered.
LONG_PIECE = 48
#: Bytes of text whose pieces are looked up together.
SLICE = 4 << 20
#: Pieces whose ids are gathered at a time.
GATHER = 1 << 17
#: Seconds after which an unused encoder goes.
IDLE = 5.0
_ENCODERS: dict[tuple[str, bool], Encoder] = {}
_USES: list[tuple[str, bool]] = []
_TIMER: list[threading.Timer] = []
_LOCK = threading.Lock()
#: Unknown pieces that the library gets as one text, a line each, and in one call.
TOGETHER, CALL = 512, 8192
#: Blanks other than ASCII's as UTF-8, by length (fixed values: the white space of Unicode, and U+180E, once one).
_WIDE = {2: ("c285", "c2a0"), 3: ("e19a80", "e1a08e", *(f"e280{x:02x}" for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), "e2819f", "e38080")}
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xCBF29CE484222325], "u8")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuttable(file: dict) -> bool:
    """Whether a tokenizer file promises that blanks after other characters are boundaries."""
    pre, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    post = (file.get("post_processor") or {}).get("type", "ByteLevel")
    return plain and file.get("normalizer") is None and file.get("truncation") is None and file.get("padding") is None and model.get("type") == "BPE" and not model.get("dropout") and post == "ByteLevel"


def _wide_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places in UTF-8 bytes follow a blank of _WIDE."""
    found = np.zeros(len(at), bool)
    some = np.nonzero(data[at - 1] >= 0x80)[0]
    if len(some):
        w, bad = at[some], np.zeros(len(some), bool)
        for n, kinds in _WIDE.items():
            full = w >= n
            code = np.zeros(len(w), "u4")
            for k in range(n):
                code[full] = code[full] << np.uint32(8) | data[w[full] - n + k]
            bad |= np.isin(code, np.array([int(x, 16) for x in kinds], "u4"))
        found[some[bad]] = True
    return found


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which a blank follows a character that isn't one; the first byte is none."""
    at = np.nonzero(_BLANK[data])[0]
    at = at[at > 0]
    at = at[~_BLANK[data[at - 1]]]
    return at[~_wide_before(data, at)]


def _parts(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes)"""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, "i8", len(pieces) + 1, pieces.offset * 8)
    n = int(offsets[-1] - offsets[0])
    return offsets - offsets[0], np.frombuffer(data, "u1", n, int(offsets[0])) if n else np.zeros(0, "u1")


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which pieces are short, hold no line feed and don't end in a blank."""
    good = np.diff(offsets) <= LONG_PIECE
    good &= offsets[1:] > offsets[:-1]
    last = offsets[1:][good]
    good[good] = ~_BLANK[data[last - 1]] & ~_wide_before(data, last)
    good[np.searchsorted(offsets, np.nonzero(data == 10)[0], side="right") - 1] = False
    return good


def hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece; of long ones, of their beginning."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")  # the longest first, so that each step works on a run
    size, start, h = size[order], offsets[:-1][order], np.full(len(order), _MIX[2], "u8")
    for j in range(min(LONG_PIECE, int(size[0])) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))
        h[:n] = (h[:n] ^ data[start[:n] + j]) * _MIX[0]
    h ^= size.astype("u8")
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    out = np.empty_like(h)
    out[order] = h ^ (h >> np.uint64(29))
    return out


class _Known:
    """Pieces and their ids: hashes in order, and for each where its bytes and ids lie. Bytes are compared, so equal hashes do no harm."""

    def __init__(self):
        self.codes, self.row = np.zeros(0, "u8"), np.zeros(0, "i4")
        self.begin, self.at = np.zeros(0, "i4"), np.zeros(0, "i4")
        self.length, self.size, self.met = np.zeros(0, "i2"), np.zeros(0, "u1"), np.zeros(0, "u1")
        self.bytes, self.ids, self.n_ids = np.zeros(0, "u1"), np.zeros(1 << 16, "<u4"), 0

    def find(self, codes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The row of each piece, or -1."""
        out = np.full(len(codes), -1, "i8")
        if not len(self.codes) or not len(codes):
            return out
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.nonzero((self.codes[k] == codes) & (self.size[self.row[k]] == np.diff(offsets)))[0]
        row, n = self.row[k[hit]].astype("i8"), np.diff(offsets)[hit]
        ends = np.cumsum(n)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        wrong = self.bytes[np.repeat(self.at[row].astype("i8"), n) + within] != data[np.repeat(offsets[hit], n) + within]
        same = np.ones(len(hit), bool)
        same[np.searchsorted(ends, np.nonzero(wrong)[0], side="right")] = False
        out[hit[same]] = row[same]
        return out

    def put(self, ids: np.ndarray) -> int:
        """Where the ids now lie."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(self.n_ids // 4 + 2 * len(ids), "<u4")])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        return self.n_ids - len(ids)

    def add(self, some: np.ndarray, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """Remember some of the pieces; of equal hashes one."""
        new, first = np.unique(codes[some], return_index=True)
        place = np.searchsorted(self.codes, new)
        free = np.ones(len(new), bool)
        if len(self.codes):
            free = self.codes[np.minimum(place, len(self.codes) - 1)] != new
        new, place, some = new[free], place[free], some[first[free]]
        n, size = len(self.begin), np.diff(offsets)[some]
        ends = np.cumsum(size)
        bytes_ = data[np.repeat(offsets[some] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        self.at = np.concatenate([self.at, (len(self.bytes) + ends - size).astype("i4")])
        self.bytes = np.concatenate([self.bytes, bytes_])
        self.begin = np.concatenate([self.begin, begin[some].astype("i4")])
        self.length = np.concatenate([self.length, length[some].astype("i2")])
        self.size = np.concatenate([self.size, size.astype("u1")])
        self.met = np.concatenate([self.met, np.ones(len(some), "u1")])
        self.codes, self.row = np.insert(self.codes, place, new), np.insert(self.row, place, np.arange(n, n + len(some), dtype="i4"))

    def forget(self) -> None:
        """Keep the pieces that were met in two slices or more since the last time, if they aren't over half of the room."""
        stay = np.nonzero(self.met > 1)[0]
        if len(stay) > CACHE_PIECES // 2:
            stay = stay[:0]
        new = np.full(len(self.met), -1, "i4")
        new[stay] = np.arange(len(stay))
        row = new[self.row]
        self.codes, self.row = self.codes[row >= 0], row[row >= 0]
        for name, of, size in (("ids", "begin", "length"), ("bytes", "at", "size")):
            n = getattr(self, size)[stay].astype("i8")
            ends = np.cumsum(n)
            places = np.repeat(getattr(self, of)[stay] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            setattr(self, name, getattr(self, name)[places])
            setattr(self, of, (ends - n).astype("i4"))
        self.length, self.size, self.met, self.n_ids = self.length[stay], self.size[stay], np.zeros(len(stay), "u1"), len(self.ids)


class Encoder:
    """special_as_text: strings of special tokens in a text count as ordinary text (the library's default is not)."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.cuts = cuttable(about)
        self.added = [t["content"] for t in about.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        line = self.model.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.cuts and len(line) == 1 else None
        self.known = _Known()

    def _library(self, pieces: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after another, and how many each has; plain: as _plain() says."""
        parts = [self._call(pieces[k : k + CALL], plain) for k in range(0, len(pieces), CALL)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _call(self, pieces: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        if plain and self.line is not None:
            # No piece ends in a blank, so a line feed after it is a token of its own.
            lines = [b"\n".join(pieces[k : k + TOGETHER]).decode() for k in range(0, len(pieces), TOGETHER)]
            if not any(t in x for x in lines for t in self.added):
                ids = np.concatenate([np.array([*x.ids, self.line], "<u4") for x in self.model.encode_batch_fast(lines, add_special_tokens=False)])
                ends = np.nonzero(ids == self.line)[0]
                if len(ends) == len(pieces):
                    return ids[ids != self.line], np.diff(ends, prepend=-1) - 1
        found = [x.ids for x in self.model.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        n = np.fromiter(map(len, found), "i8", len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(n.sum())), n

    def _places(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) in the known ids of each distinct piece. What isn't remembered lies there until the next call."""
        k = self.known
        offsets, data = _parts(pieces)
        codes = hashed(data, offsets)
        at = k.find(codes, data, offsets)
        old = at >= 0
        begin, length = np.zeros(len(at), "i8"), np.zeros(len(at), "i8")
        begin[old], length[old] = k.begin[at[old]], k.length[at[old]]
        k.met[at[old]] = 2
        plain = _plain(data, offsets)
        for kind in (True, False):
            some = np.nonzero(~old & (plain == kind))[0]
            if not len(some):
                continue
            ids, n = self._library(pieces.take(pa.array(some)).to_pylist(), kind)
            begin[some], length[some] = k.put(ids) + np.cumsum(n) - n, n
        short = np.nonzero(~old & (np.diff(offsets) <= LONG_PIECE))[0]
        k.add(short, codes, begin, length, data, offsets)
        return begin, length

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each); end_id, if given, follows each text. Null: empty."""
        if len(self.known.codes) > CACHE_PIECES or self.known.n_ids > 16 * CACHE_PIECES:
            self.known.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pa.concat_arrays([texts])  # its offsets begin at 0 from here on
        n = len(texts)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, "i8", n + 1, texts.offset * 8)
        base, ends = int(ends[0]), ends - ends[0]
        data = np.frombuffer(data, "u1", int(ends[-1]), base) if ends[-1] else np.zeros(0, "u1")
        cuts = np.zeros(0, "i8")
        if self.cuts:
            cuts = boundaries(data)
            held = np.zeros(n, bool)
            for x in self.added:
                held |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
            cuts = cuts[ends[np.searchsorted(ends, cuts)] != cuts]
            if held.any():
                cuts = cuts[~held[np.searchsorted(ends, cuts, side="right") - 1]]
        # A piece begins at each text's begin and each cut; empty texts give empty pieces.
        begins = np.sort(np.concatenate([ends, cuts]), kind="stable")
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(np.ascontiguousarray(begins, "i8")), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        begin, length = self._places(coded.dictionary)
        codes = coded.indices.to_numpy()
        sums = np.concatenate([[0], np.cumsum(length[codes])])
        ids = np.empty(sums[-1], "<u4")
        for k in range(0, len(codes), GATHER):
            c, at = codes[k : k + GATHER], sums[k : k + GATHER + 1]
            ids[at[0] : at[-1]] = self.known.ids[np.repeat(begin[c] - at[:-1], length[c]) + np.arange(at[0], at[-1])]
        cuts_before = np.searchsorted(cuts, ends)
        of_text = sums[np.arange(n + 1) + cuts_before]
        counts = np.diff(of_text)
        if end_id is not None:
            ids, counts = np.insert(ids, of_text[1:], end_id), counts + 1
        return ids, counts


@contextlib.contextmanager
def encoder(path: str | None = None, special_as_text: bool = False) -> Iterator[Encoder]:
    """One encoder a worker process, vocabulary file and setting. Workers outlive a stage, so one that isn't used for IDLE
    seconds is let go, and its memory given back."""
    key = path or default_path(), special_as_text
    with _LOCK:
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        found = _ENCODERS[key]
        _USES.append(key)
    try:
        yield found
    finally:
        with _LOCK:
            _USES.remove(key)
            if _TIMER:
                _TIMER.pop().cancel()
            _TIMER.append(threading.Timer(IDLE, _let_go))
            _TIMER[0].daemon = True
            _TIMER[0].start()


def _let_go() -> None:
    with _LOCK:
        if not _USES:
            _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
        ctypes.CDLL(None).malloc_trim(0)
