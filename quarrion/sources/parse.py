"""Parsers from a file's text to symbols or sections, one file a call, and the operators that apply them to a table.

Python is parsed by its own grammar. Other languages are scanned for declarations by pattern and for bodies by
braces, aware of strings and comments; that is an approximation of a grammar, and stated as such.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "path string, name string, kind string, start_line int, end_line int, body string, docstring string, parent string"
# Limits of contract files, and declarations by language family.
MAX_NODES, MAX_DEPTH = 20_000, 64
METHODS = ("get", "put", "post", "delete", "patch", "head", "options", "trace")
DECLARATIONS = (
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|abstract\s+|final\s+)*class\s+(\w+)"),
    ("interface", r"^\s*(?:export\s+)?(?:public\s+)?interface\s+(\w+)"),
    ("struct", r"^\s*(?:pub\s+)?(?:type\s+(\w+)\s+struct\b|struct\s+(\w+))"),
    ("interface", r"^\s*type\s+(\w+)\s+interface\b"),
    ("enum", r"^\s*(?:export\s+)?(?:pub\s+)?enum\s+(\w+)"),
    ("method", r"^\s*func\s+\([^)]*\)\s*(\w+)\s*\("),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*[<(]"),
    ("function", r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|func)\s+(\w+)\s*[<(]"),
    ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*="),
    ("variable", r"^\s*(?:export\s+)(?:const|let|var)\s+(\w+)"),
    ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+)*(\w+)\s*\([^;]*\)\s*(?::\s*[^{;]+)?\{\s*$"),
)
NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "else", "do"}


def markdown(text: str) -> list[dict]:
    """Sections of a document: title, depth, path of titles, lines and content; headings inside fences don't count.

    What stands before the first heading is a section without title, of depth 0; a head of `key: value` lines is dropped.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    at = 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        at = next(i for i, x in enumerate(lines) if i and x.strip() == "---") + 1
    out, fence, titles = [], False, []
    begin, title, depth = at, None, 0

    def close(end: int) -> None:
        body = "\n".join(lines[begin:end]).strip("\n")
        if title is not None or body.strip():
            out.append({"title": title, "depth": depth, "titles": [t for _, t in titles], "start": begin + 1, "end": end, "content": body})

    for i in range(at, len(lines)):
        if lines[i].lstrip().startswith("```"):
            fence = not fence
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*$", lines[i])
        if m:
            close(i)
            depth, title, begin = len(m[1]), m[2], i
            titles = [(d, t) for d, t in titles if d < depth] + [(depth, title)]
    close(len(lines))
    return out


def frontmatter(text: str) -> dict[str, str]:
    m = re.match(r"---\r?\n(.*?)\r?\n---", text, re.S)
    pairs = (x.split(":", 1) for x in (m[1].splitlines() if m else []) if ":" in x)
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def python(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []

    def visit(node, parent):
        for n in getattr(node, "body", []):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent else "function"
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                out.append({"name": n.name, "kind": kind, "start": first, "end": n.end_lineno, "body": "\n".join(lines[first - 1 : n.end_lineno]), "docstring": ast.get_docstring(n), "parent": parent})
                if kind == "class":
                    visit(n, n.name)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                target = n.names[0].name if isinstance(n, ast.Import) else "." * n.level + (n.module or "")
                out.append({"name": target, "kind": "import", "start": n.lineno, "end": n.end_lineno, "body": "\n".join(lines[n.lineno - 1 : n.end_lineno]), "docstring": None, "parent": None})

    visit(tree, None)
    return out


def strip_code(text: str, keep_length: bool = False) -> str:
    """text without comments; with keep_length, comments and strings are blanks instead."""
    pattern = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)

    def one(m: re.Match) -> str:
        if keep_length:
            return re.sub(r"[^\n]", " ", m[0])
        return "" if m[0].startswith(("//", "/*")) else m[0]

    return pattern.sub(one, text)


def braces(text: str) -> list[dict]:
    """Declarations of a language with braces, with the lines up to the closing one."""
    lines, plain, out = text.split("\n"), strip_code(text, True).split("\n"), []
    owner: list[tuple[str, int]] = []
    for i, line in enumerate(plain):
        owner = [o for o in owner if i + 1 <= o[1]]
        m = re.match(r"""\s*import\s+(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]""", lines[i])
        if m:
            out.append({"name": m[1], "kind": "import", "start": i + 1, "end": i + 1, "body": lines[i], "docstring": None, "parent": None})
            continue
        for kind, pattern in DECLARATIONS:
            if not (m := re.match(pattern, line)):
                continue
            name = next(x for x in m.groups() if x)
            if name in NOT_METHODS or kind == "method" and not owner and not line.lstrip().startswith("func"):
                continue
            depth, end, opened = 0, i, False
            for j in range(i, len(plain)):
                depth += plain[j].count("{") - plain[j].count("}")
                opened = opened or "{" in plain[j]
                end = j
                if opened and depth <= 0 or not opened and plain[j].rstrip().endswith(";"):
                    break
            if owner and kind in ("variable", "function") and not line.lstrip().startswith(("fn", "func", "pub")):
                break
            above, k = [], i - 1
            while k >= 0 and re.match(r"\s*(//|/?\*)", lines[k]):
                above.insert(0, re.sub(r"^\s*(//+|/?\*+/?)\s?|\s*\*/\s*$", "", lines[k]))
                k -= 1
            out.append({"name": name, "kind": kind, "start": i + 1, "end": end + 1, "body": "\n".join(lines[i : end + 1]), "docstring": "\n".join(above).strip() or None, "parent": owner[-1][0] if owner else None})
            if kind in ("class", "interface", "struct"):
                owner.append((name, end + 1))
            break
    return out


def config(path: str, text: str) -> list[dict]:
    """Top keys of json and yaml; sections and keys of toml and ini. One symbol a line."""
    out = []
    tail = path.rsplit(".", 1)[-1].lower()
    for i, line in enumerate(text.split("\n")):
        m = None
        if tail == "json":
            m = re.match(r'(?: {0}| {2})"([^"]+)"\s*:', line)
        elif tail in ("yaml", "yml"):
            m = re.match(r"([A-Za-z_][\w.-]*)\s*:", line)
        elif s := re.match(r"\s*\[+([^\]]+)\]+", line):
            out.append((s[1].strip(), "struct", i, line))
        else:
            m = re.match(r"\s*([A-Za-z_][\w.-]*)\s*=", line)
        if m:
            out.append((m[1], "variable", i, line))
    return [{"name": n, "kind": k, "start": i + 1, "end": i + 1, "body": b, "docstring": None, "parent": None} for n, k, i, b in out]


def _data(text: str):
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            return None
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError:
            return None


def _size(value, depth: int = 0, seen: frozenset = frozenset()) -> int:
    """Nodes of a tree; too deep or cyclic ones raise."""
    if depth > MAX_DEPTH or id(value) in seen:
        raise ValueError("too deep or cyclic")
    if isinstance(value, (dict, list)):
        inner = value.values() if isinstance(value, dict) else value
        return 1 + sum(_size(x, depth + 1, seen | {id(value)}) for x in inner)
    return 1


def openapi(text: str) -> dict | None:
    """{kind, operations: [{id, method, path, line}], schemas: [names]} of an OpenAPI 3 or Swagger 2 document, else None."""
    doc = _data(text)
    if not isinstance(doc, dict) or not (str(doc.get("openapi", "")).startswith("3") or str(doc.get("swagger", "")).startswith("2")):
        return None
    try:
        if _size(doc) > MAX_NODES:
            return None
    except (ValueError, RecursionError):
        return None
    lines, found = text.split("\n"), []
    for path, item in (doc.get("paths") or {}).items():
        for method in METHODS:
            op = item.get(method) if isinstance(item, dict) else None
            if isinstance(op, dict):
                line = next((i + 1 for i, x in enumerate(lines) if path in x), 1)
                found.append({"id": op.get("operationId") or f"{method.upper()} {path}", "method": method.upper(), "path": path, "line": line})
    schemas = (doc.get("components") or {}).get("schemas") or doc.get("definitions") or {}
    return {"kind": "openapi" if "openapi" in doc else "swagger", "operations": found, "schemas": sorted(schemas)}


def protobuf(text: str) -> dict:
    """{kind, package, operations: [{id, service, request, response, client_stream, server_stream, line}], schemas}."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    tokens = [(m[0], clean.count("\n", 0, m.start()) + 1) for m in re.finditer(r'"(?:\\.|[^"\\])*"|[\w.]+|[{}();=<>,\[\]]', clean)]
    words = [t for t, _ in tokens]
    package, service, level, depth, ops, schemas = "", None, 0, 0, [], []
    for i, (t, line) in enumerate(tokens):
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if service and depth < level:
                service = None
        elif t == "package" and depth == 0:
            package = words[i + 1]
        elif t in ("message", "enum") and words[i + 2 : i + 3] == ["{"]:
            schemas.append(words[i + 1])
        elif t == "service" and depth == 0:
            service, level = words[i + 1], depth + 1
        elif t == "rpc" and service:
            j = i + 3
            client = words[j] == "stream"
            request = words[j + client]
            j = words.index("returns", j) + 2
            server = words[j] == "stream"
            ops.append({"id": f"{service}.{words[i + 1]}", "service": service, "request": request, "response": words[j + server], "client_stream": client, "server_stream": server, "line": line})
    return {"kind": "protobuf", "package": package, "operations": ops, "schemas": sorted(schemas)}


def contract(path: str, text: str) -> dict | None:
    return protobuf(text) if path.lower().endswith(".proto") else openapi(text)


def inspected(found: dict, operation: str | None = None, limit: int = 20, with_schemas: bool = False) -> dict:
    """A contract's operations by part of their id or path; an unknown or ambiguous exact question is an error in `problem`."""
    limit = max(1, min(limit, 100))
    ops = [o for o in found["operations"] if not operation or operation.lower() in o["id"].lower() or operation in o.get("path", "")]
    exact = [o for o in ops if o["id"] == operation]
    return {"operations": (exact or ops)[:limit], "total": len(ops), "problem": "not found" if operation and not ops else None} | ({"schemas": sorted(found["schemas"])} if with_schemas else {})


def symbols_of(path: str, language: str | None, parser: str, text: str) -> list[dict]:
    if parser in ("protobuf", "config"):
        found = contract(path, text)
        if found:
            ops = [{"name": o["id"], "kind": "function", "start": o["line"], "end": o["line"], "body": json.dumps(o), "docstring": None, "parent": o.get("service")} for o in found["operations"]]
            return ops + [{"name": s, "kind": "struct", "start": 1, "end": 1, "body": s, "docstring": None, "parent": None} for s in found["schemas"]]
        return config(path, text)
    if language == "python":
        return python(text)
    return braces(text) if parser == "code" else []


def applied(files: DataFrame, parse: Callable[..., list[dict]] = symbols_of) -> DataFrame:
    """Symbols of files(path, language, parser, text); a file that can't be parsed has none."""

    def run(batches):
        for pdf in batches:
            rows = [(p, s["name"], s["kind"], s["start"], s["end"], s["body"], s["docstring"], s["parent"]) for p, lang, kind, text in zip(pdf.path, pdf.language, pdf.parser, pdf.text, strict=True) for s in parse(p, lang if isinstance(lang, str) else None, kind, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.select("path", "language", "parser", "text").mapInPandas(run, SYMBOLS)
