"""Chunkers: sections, symbols and long bodies to chunks of bounded tokens with stable ids."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

from quarrion.config import Config
from quarrion.operators.compiling import tokens
from quarrion.sources import parse

CHUNKS = "id string, source_file string, section_title string, section_depth int, content string, keywords array<string>, hash string, token_count int, language string, symbol_name string, symbol_kind string, parent_symbol string, start_line int, end_line int, file_stem string"
# A segment's aim and bounds in tokens, and the shortest tail that stands alone.
SEGMENT, SOFT, READY, HARD, TAIL = 320, 0.55, 0.7, 1.35, 80
OUTLINE_TOKENS, WHOLE_FILE_CHARS, WHOLE_FILE_LEAST = 900, 8000, 40


def chunk_id(path: str, title: str) -> str:
    """Stable under edits of the content."""
    return hashlib.md5(f"{path}:{title}".encode()).hexdigest()


def blocks(text: str) -> list[str]:
    """Paragraphs; a fenced block is one, with its empty lines."""
    out, cur, fence = [], [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
        if not line.strip() and not fence:
            if cur:
                out.append("\n".join(cur))
            cur = []
        else:
            cur.append(line)
    return out + (["\n".join(cur)] if cur else [])


def hard_split(text: str, most: int) -> list[str]:
    """By lines, and a line that's too long by words, and a word that's too long by length."""
    out, cur = [], ""
    for line in text.split("\n"):
        parts = [line]
        if tokens(line) > most:
            parts, held = [], ""
            for w in line.split(" "):
                for piece in [w[k : k + most * 3] for k in range(0, len(w), most * 3)] or [""]:
                    if held and tokens(f"{held} {piece}") > most:
                        parts.append(held)
                        held = piece
                    else:
                        held = f"{held} {piece}" if held else piece
            parts.append(held)
        for p in parts:
            if cur and tokens(f"{cur}\n{p}") > most:
                out.append(cur)
                cur = p
            else:
                cur = f"{cur}\n{p}" if cur else p
    return [*out, cur] if cur else out


def split_text(text: str, most: int) -> list[str]:
    """Blocks packed greedily up to `most` tokens; a larger block is split."""
    out, cur = [], ""
    for b in blocks(text):
        for p in [b] if tokens(b) <= most else hard_split(b, most):
            if cur and tokens(f"{cur}\n\n{p}") > most:
                out.append(cur)
                cur = p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
    return [*out, cur] if cur else out


def breadcrumb(titles: list[str]) -> str:
    return " > ".join(titles if len(titles) <= 3 else [titles[0], "…", *titles[-2:]])


def _boundary(line: str, before: str | None) -> bool:
    """Where a long body may be cut softly: an empty line, a comment that begins, or a statement after a closed block."""
    return not line.strip() or bool(re.match(r"\s*(//|#|/\*)", line)) or bool(before and re.match(r"\s*[}\])]+[;,]?\s*$", before))


def segments(body: str, target: int = SEGMENT) -> list[tuple[int, int, str | None]]:
    """(first line, last line, label) from 0, without gaps: cut at a soft boundary from 0.7 of the target on, and at 1.35 anyway;
    a short tail joins the one before. The label is a comment at the top."""
    lines, out, begin, used, before = body.split("\n"), [], 0, 0, None
    for i, line in enumerate(lines):
        if i > begin and (used >= HARD * target or used >= READY * target and _boundary(line, before)):
            out.append((begin, i - 1))
            begin, used = i, 0
        used += tokens(line + "\n")
        before = line if line.strip() else before
    out.append((begin, len(lines) - 1))
    if len(out) > 1 and tokens("\n".join(lines[out[-1][0] :])) < TAIL:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])

    def label(a: int) -> str | None:
        m = next((m for x in lines[a : a + 3] if (m := re.match(r"\s*(?://|#|/\*+|\*)\s*(.+?)\s*(?:\*/)?$", x))), None)
        return m[1][:72] if m else None

    return [(a, b, label(a)) for a, b in out]


def _name_words(name: str) -> list[str]:
    parts = re.split(r"[_\-.]", name)
    humps = [h for p in parts for h in ([p] if p.isupper() else re.split(r"(?<=[a-z0-9])(?=[A-Z])", p))]
    return list(dict.fromkeys(h.lower() for h in humps if len(h) > 2))


def _unique(rows: list[dict]) -> list[dict]:
    seen: dict[str, int] = {}
    for r in rows:
        n = seen.get(r["title"], 0)
        seen[r["title"]] = n + 1
        r["key"] = r["title"] + (f"#dup{n}" if n else "")
    return rows


def document(path: str, text: str, most: int) -> list[dict]:
    rows = []
    for s in parse.markdown(text):
        title = breadcrumb(s["titles"]) or path.rsplit("/", 1)[-1]
        for k, part in enumerate(split_text(s["content"], most)):
            rows.append({"title": title, "part": k, "depth": s["depth"], "content": part, "start": s["start"], "end": s["end"]})
    for r in rows:
        r["title"] = r["title"] if not r["part"] else f"{r['title']} ({r['part'] + 1})"
    return _unique(rows)


def code(path: str, symbols: list[dict], text: str, most: int) -> list[dict]:
    """A chunk a symbol; a class is its outline if it's long; a long function also has segments; a file has a list of its symbols."""
    real = [s for s in symbols if s["kind"] != "import" and not (s["kind"] in ("function", "method") and len(s["name"]) <= 2)]
    rows = []
    for s in real:
        title = f"{s['parent']}.{s['name']}" if s["parent"] else s["name"]
        body = s["body"]
        if s["kind"] in ("class", "struct") and tokens(body) > OUTLINE_TOKENS:
            inner = [f"  {c['kind']} {c['name']} ({c['start']}-{c['end']})" for c in real if c["parent"] == s["name"]]
            body = "\n".join([body.split("\n", 1)[0], *inner])
        common = {"depth": 1, "name": s["name"], "kind": s["kind"], "parent": s["parent"], "start": s["start"], "end": s["end"]}
        rows.append({"title": title, "content": body, **common})
        if s["kind"] in ("function", "method") and tokens(body) > most:
            lines = body.split("\n")
            for k, (a, b, label) in enumerate(segments(body)):
                rows.append({"title": f"{title}#seg{k}", "content": "\n".join(lines[a : b + 1]), **common, "kind": "segment", "parent": s["name"], "name": label, "start": s["start"] + a, "end": s["start"] + b})
    if real:
        listing = [f"{s['kind']} {s['name']} ({s['start']}-{s['end']})" for s in real]
        rows.append({"title": "File Structure", "content": "\n".join([path, *listing]), "depth": 0, "name": path.rsplit("/", 1)[-1], "kind": "file", "parent": None, "start": 1, "end": text.count("\n") + 1})
    elif len(text.strip()) > WHOLE_FILE_LEAST:
        rows.append({"title": path.rsplit("/", 1)[-1], "content": text[:WHOLE_FILE_CHARS], "depth": 0, "name": None, "kind": "file", "parent": None, "start": 1, "end": text.count("\n") + 1})
    return _unique(rows)


def chunked(files: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Chunks of files(path, language, parser, text); ids and order follow from the file alone."""
    cfg = cfg or Config()
    doc_most, code_most = cfg.max_chunk_tokens, cfg.max_symbol_chunk_tokens

    def one(path: str, language: str | None, kind: str, text: str) -> list[tuple]:
        rows = document(path, text, doc_most) if kind in ("markdown", "text") else code(path, parse.symbols_of(path, language, kind, text), text, code_most)
        stem = re.sub(r"(?<=.)\.[^.]+$", "", path.rsplit("/", 1)[-1])
        return [
            (chunk_id(path, r["key"]), path, r["title"], r["depth"], r["content"], _name_words(r.get("name") or r["title"]), hashlib.sha256(r["content"].encode()).hexdigest(), tokens(r["content"]), language, r.get("name"), r.get("kind"), r.get("parent"), r["start"], r["end"], stem)
            for r in rows
        ]

    def run(batches):
        for pdf in batches:
            rows = [r for p, lang, kind, text in zip(pdf.path, pdf.language, pdf.parser, pdf.text, strict=True) for r in one(p, lang if isinstance(lang, str) else None, kind, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return files.select("path", "language", "parser", "text").mapInPandas(run, CHUNKS)
