"""Scalar functions on text and names, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these words, limits and patterns.
STOPWORDS = (
    "the a an and or but is are was were be been in on at to for with by about as into like of off over under up down "
    "from this that these those it its they their we our you your i my me he his she her not no yes so can will just "
    "how why what where when who do does did done doing have has had would could should shall may might must need also "
    "very more most much many some any all both each every other another such than too then there here out if because "
    "until while after before between through only own same"
).split()
NOT_IDENTIFIERS = ("DB", "ID", "API", "SQL", "CLI")
CODE_SUFFIX = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs)$"
SHAPES = {
    "camel": r"^[a-z]+(?:[A-Z][a-z0-9]*)+$",
    "pascal": r"^[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]+)+$",
    "snake": r"^[a-z]+(?:_[a-z0-9]+)+$",
    "dotted": r"^[a-z]+(?:\.[a-z]+)+$",
    "upper": r"^[A-Z][A-Z0-9_]{2,}$",
}
INTENTS = (
    ("fix", r"\b(fix|bug|error|issue|broken|crash)\b"),
    ("implement", r"\b(add|implement|create|build|new)\b"),
    ("explain", r"\b(explain|describe|understand)\b"),
    ("refactor", r"\b(refactor|clean|improve|optimize)\b"),
    ("deploy", r"\b(deploy|release|ship|merge)\b"),
    ("test", r"\b(test|spec|coverage)\b"),
    ("pr", r"\b(pr|pull request|review)\b"),
)
UNIGRAMS, BIGRAMS, TRIGRAMS, IDENTIFIERS = 12, 5, 3, 30


def stopwords() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def splittable(text: Column) -> Column:
    """Lower-cased, with blanks for what words() doesn't know as a character, so that Arrow, whose Unicode is newer, splits it into the same words."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(low, r"\p{Cn}", " "))


def tokenize(text: Column) -> Column:
    """Contractions are spelled out, then runs of word characters, dots and dashes, of two characters or more."""
    t = F.regexp_replace(text, r"\b([A-Za-z]+)'s\b", "$1 is")
    for tail, word in (("re", "are"), ("ve", "have"), ("ll", "will"), ("d", "would")):
        t = F.regexp_replace(t, rf"(?i)\b([A-Za-z]+)'{tail}\b", f"$1 {word}")
    t = F.regexp_replace(t, r"\b([Nn])'t\b", "$1ot")
    return F.filter(F.split(t, r"[^A-Za-z0-9_.\-]+"), lambda x: (F.length(x) > 1) & ~x.rlike(r"^[-_.]+$"))


def meaningful(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: ~F.lower(x).isin(*STOPWORDS))


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n + 1
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))


def concepts(tokens: Column) -> Column:
    """Distinct lower-cased unigrams (and their names without a file suffix), bigrams and trigrams, capped."""
    low = F.transform(meaningful(tokens), lambda x: F.lower(x))
    base = F.transform(F.slice(low, 1, UNIGRAMS), lambda x: F.regexp_replace(x, r"\.(ts|tsx|js|jsx|mjs|cjs|md)$", ""))
    both = F.flatten(F.zip_with(F.slice(low, 1, UNIGRAMS), base, lambda x, y: F.when((x != y) & (F.length(y) >= 3), F.array(x, y)).otherwise(F.array(x))))
    return F.array_distinct(F.concat(both, F.slice(ngrams(low, 2), 1, BIGRAMS), F.slice(ngrams(low, 3), 1, TRIGRAMS)))


def is_identifier(x: Column) -> Column:
    shaped = F.lit(False)
    for pattern in SHAPES.values():
        shaped = shaped | x.rlike(pattern)
    return shaped


def identifiers(prompt: Column) -> Column:
    """Names in a prompt: shaped ones, adjacent words joined in camel and Pascal case, and explicit calls."""
    found = [F.regexp_extract_all(prompt, F.lit(p), F.lit(0)) for p in (r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b", r"\b[a-z]+(?:_[a-z0-9]+)+\b", r"\b[a-z]+(?:\.[a-z]+)+\b")]
    # A capitalised word that begins a sentence is a name only if its shape says so.
    found.append(F.filter(F.regexp_extract_all(prompt, F.lit(r"(?<![.!?]\s{0,9})(?<!^\s{0,9})\b[A-Z][a-zA-Z0-9]+\b"), F.lit(0)), lambda x: F.lit(True)))
    found.append(F.filter(F.regexp_extract_all(prompt, F.lit(r"\b[A-Z][a-zA-Z0-9]+\b"), F.lit(0)), lambda x: ~x.rlike("^[A-Z][a-z]+$")))
    found.append(F.regexp_extract_all(prompt, F.lit(r"\b[A-Z][A-Z0-9_]{2,}\b"), F.lit(0)))
    raw = F.transform(F.concat(*found), lambda x: F.regexp_replace(x, CODE_SUFFIX, ""))
    raw = F.filter(raw, lambda x: (F.length(x) > 1) & ~x.isin(*NOT_IDENTIFIERS))
    named = F.filter(F.array_distinct(F.concat(raw, joined_names(meaningful(tokenize(prompt))))), lambda x: ~F.lower(x).isin(*STOPWORDS) & (is_identifier(x) | x.rlike("^[A-Z][a-z]{3,}$") | x.rlike("^[a-z]+[A-Z][a-zA-Z]+$")))
    return F.array_distinct(F.slice(F.concat(named, explicit_names(prompt)), 1, IDENTIFIERS))


def joined_names(tokens: Column) -> Column:
    """fooBar and FooBar for neighbouring words of three letters or more."""
    t = F.transform(tokens, lambda x: F.regexp_replace(x, CODE_SUFFIX, ""))
    last = F.size(t) - 1
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000)))
    pairs = F.transform(
        F.sequence(F.lit(0), last - 1),
        lambda i: F.when((F.length(F.get(t, i)) >= 3) & (F.length(F.get(t, i + 1)) >= 3), F.array(F.concat(F.lower(F.get(t, i)), cap(F.get(t, i + 1))), F.concat(cap(F.get(t, i)), cap(F.get(t, i + 1))))).otherwise(F.array().cast("array<string>")),
    )
    made = F.filter(F.flatten(pairs), lambda x: is_identifier(x) | x.rlike("^[a-z]+[A-Z]"))
    return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))


def explicit_names(prompt: Column) -> Column:
    """name() and `name`."""
    found = F.concat(F.regexp_extract_all(prompt, F.lit(r"\b([a-zA-Z0-9_]+)\(\)"), F.lit(1)), F.regexp_extract_all(prompt, F.lit(r"`([a-zA-Z0-9_]+)`"), F.lit(1)))
    return F.filter(found, lambda x: ~F.lower(x).isin(*STOPWORDS))


def quoted(prompt: Column) -> Column:
    found = F.transform(F.regexp_extract_all(prompt, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def intent(prompt: Column) -> Column:
    """The first class whose pattern occurs."""
    low, out = F.lower(prompt), F.lit("general")
    for name, pattern in reversed(INTENTS):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def match_tokens(tokens: Column) -> Column:
    """Each token with its spellings without separators and its plain English stems."""

    def forms(raw: Column) -> Column:
        t = F.regexp_replace(F.lower(raw), CODE_SUFFIX, "")
        n = F.length(t)
        no = F.lit(None).cast("string")
        cut = lambda tail, k, least, add="": F.when(t.endswith(tail) & (n > least), F.concat(F.substring(t, F.lit(1), n - k), F.lit(add))).otherwise(no)
        made = F.array(t, F.translate(t, "_", "-"), F.translate(t, "-", "_"), F.regexp_replace(t, "[_-]", ""), cut("ion", 3, 6), cut("ing", 3, 5), cut("ing", 3, 5, "er"), cut("ed", 2, 5), cut("ies", 3, 5, "y"), cut("es", 2, 5), cut("s", 1, 4))
        parts = F.filter(F.split(t, "[_-]+"), lambda p: F.length(p) >= 4)
        return F.when(n >= 3, F.filter(F.concat(made, parts), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(tokens, forms)))


def stem_variants(stem: Column) -> Column:
    """Spellings under which a file may be named after a term."""
    r = F.regexp_replace
    parts = F.filter(F.transform(F.split(stem, "(?=[A-Z])"), lambda x: F.lower(x)), lambda x: F.length(x) >= 3)
    made = F.array(stem, r(stem, "ing$", "er"), r(stem, "ing$", ""), r(stem, "ion$", ""), r(stem, "tion$", "t"), r(stem, "s$", ""), F.translate(stem, "_", "-"), F.translate(stem, "-", "_"))
    return F.filter(F.array_distinct(F.concat(made, parts)), lambda x: F.length(x) >= 3)


def name_parts(name: Column) -> Column:
    """Parts of a name of over two characters: separators, then humps; all-capitals stay whole."""
    pieces = F.filter(F.split(name, r"[_\-.]"), lambda x: x != "")
    humps = F.flatten(F.transform(pieces, lambda x: F.when(x.rlike("^[A-Z0-9]+$"), F.array(x)).otherwise(F.split(x, "(?<=[a-z0-9])(?=[A-Z])"))))
    return F.filter(F.transform(humps, lambda x: F.lower(x)), lambda x: F.length(x) > 2)


def keywords(content: Column, title: Column) -> Column:
    """Title words, inline code and capitalised words, without stopwords."""
    code = F.regexp_extract_all(content, F.lit("`([^`\n]+)`"), F.lit(1))
    caps = F.regexp_extract_all(content, F.lit(r"\b[A-Z][a-zA-Z0-9]{2,}\b"), F.lit(0))
    low = F.transform(F.concat(words(F.coalesce(title, F.lit(""))), code, caps), lambda x: F.lower(x))
    return F.filter(F.array_distinct(low), lambda x: (F.length(x) > 2) & ~x.isin(*STOPWORDS))


def token_estimate(text: Column, calibration: float = 1.0) -> Column:
    """Tokens by length and by the share of code punctuation."""
    n = F.length(text)
    code = F.least(F.regexp_count(text, F.lit(r"[{}()\[\];=<>]")) / F.greatest(n, F.lit(1)), F.lit(0.5))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.ceil(n / (F.lit(4.5) - code * 3) * F.lit(calibration)))


def fts_term(term: Column) -> Column:
    """A term without quotes, dashes and operator words."""
    t = F.regexp_replace(F.translate(term, '"', " "), "[-–—]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(AND|OR|NOT)\b", " "), r"\s+", " "))


def fts_query(query: Column) -> Column:
    """A query of quoted phrases joined by operators, without empty phrases and dangling operators."""
    units = F.regexp_extract_all(query, F.lit('"[^"]*"|\\b(?:AND|OR|NOT)\\b|[^\\s"]+'), F.lit(0))
    blank = lambda x: x.startswith('"') & ~x.rlike(r"[\p{L}\p{N}]")
    operator = lambda x: x.isin("AND", "OR", "NOT")
    none = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        """An operator waits for an operand on either side; of several in a row the first holds."""
        glue = F.when(acc["out"] == "", none).when(acc["op"] == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), acc["op"], F.lit(" ")))
        waiting = F.when(acc["op"] == "", x).otherwise(acc["op"])
        out = F.when(operator(x), acc["out"]).otherwise(F.concat(acc["out"], glue, x))
        return F.struct(out.alias("out"), F.when(operator(x), waiting).otherwise(none).alias("op"))

    return F.aggregate(F.filter(units, lambda x: ~blank(x)), F.struct(none.alias("out"), none.alias("op")), step, lambda acc: acc["out"])


def importance(path: Column) -> Column:
    """1 to 10 from a file's name and folder."""
    low = F.lower(path)
    base = F.lit(5)
    for pattern, points in ((r"(^|/)readme(\.|$)", 3), (r"(^|/)(index|main|app|server)\.[a-z]+$", 2), (r"(^|/)(src|lib|core)/", 1), (r"\.(test|spec)\.|(^|/)tests?/", -2), (r"(^|/)(docs?|examples?)/", -1), (r"\.(json|ya?ml|toml|ini)$", -1)):
        base = base + F.when(low.rlike(pattern), F.lit(points)).otherwise(F.lit(0))
    return F.least(F.greatest(base, F.lit(1)), F.lit(10))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]+$", "")


def escape_xml(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def escape_cdata(x: Column) -> Column:
    return F.replace(x, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def canonical_space(text: Column) -> Column:
    """Line ends, trailing blanks and runs of empty lines made uniform; common indentation dropped and the rest halved."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    indent = F.array_min(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(F.regexp_extract(x, "^( *)", 1))))
    dedent = F.transform(lines, lambda x: F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x)))
    halved = F.transform(dedent, lambda x: F.concat(F.repeat(F.lit(" "), (F.length(F.regexp_extract(x, "^( *)", 1)) / 2).cast("int")), F.regexp_replace(x, "^ *", "")))
    return F.trim(F.regexp_replace(F.array_join(halved, "\n"), "\n{3,}", "\n\n"))


def ref(view: Column, kind: str, local: Column) -> Column:
    """quarrion:{view}:{kind}:{local id, percent-encoded}"""
    return F.concat_ws(":", F.lit("quarrion"), view, F.lit(kind), F.replace(F.url_encode(local), F.lit("+"), F.lit("%20")))


def parse_ref(r: Column) -> Column:
    p = F.split(r, ":", 4)
    ok = (F.size(p) == 4) & (F.get(p, F.lit(0)) == "quarrion")
    return F.when(ok, F.struct(F.get(p, F.lit(1)).alias("view_id"), F.get(p, F.lit(2)).alias("kind"), F.url_decode(F.get(p, F.lit(3))).alias("local_id")))


def recency(updated_ms: Column, as_of_ms: Column) -> Column:
    days = F.greatest((as_of_ms - updated_ms) / 86_400_000.0, F.lit(0.0))
    return F.lit(1.0) + 0.12 * F.exp(-days / 45.0)


def age_label(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat((s / 60).cast("long").cast("string"), F.lit("m"))).when(s < 86_400, F.concat((s / 3600).cast("long").cast("string"), F.lit("h"))).otherwise(F.concat((s / 86_400).cast("long").cast("string"), F.lit("d")))


def embedding_text(summary: Column, keys: Column, symbol: Column, title: Column, content: Column) -> Column:
    head = F.substring(F.array_join(F.slice(F.split(content, "\n"), 1, 40), "\n"), 1, 500)
    return F.concat_ws("\n", summary, F.array_join(keys, ", "), symbol, title, head)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
