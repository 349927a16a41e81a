"""Preparing chunk contents for a context: comments, config files, test files, signal terms, exact token counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrion.functions import text as T

# Words that say nothing as signals, the file endings that a stem loses, and the paths of tests.
WEAK_SIGNALS = frozenset(
    """the and for how with from that this into during using are was what when where which than then also just a an or to of in on is be by as at
    score file path chunk type name data list item info value index count total result error test config option source target start final merge store manager handler""".split()
)
ENDINGS = r"\.(ts|tsx|js|jsx|mjs|cjs|md|json|ya?ml)$"
TEST_PATHS = r"(?i)\.(test|spec)\.|vitest\.config|/fixtures/"

#: A string in any of three quotes, up to its end or the text's.
_QUOTED = "|".join(rf"{q}[^{q}\\]*+(?:\\(?s:.)[^{q}\\]*+)*+(?:{q}|\\?\z)" for q in "\"'`")


def strip_comments(code: Column) -> Column:
    """code without // and /* */ comments, but for those inside strings, and without the blank lines that this leaves."""
    bare = F.regexp_replace(code, rf"({_QUOTED})|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, r"(?m)^\s*[\r\n]", "")


def minify_json(content: Column) -> Column:
    """JSON without white space between its parts, keys in their order, numbers and escapes as written; null if it isn't JSON."""
    valid = F.try_parse_json(content).isNotNull()
    return F.when(valid, F.regexp_replace(content, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]++', "$1"))


def prepared(content: Column, language: Column) -> Column:
    """JSON minified, if it parses; all else with canonical white space."""
    json_ = F.lower(F.coalesce(language, F.lit(""))).isin("json", "jsonc")
    return F.when(json_, F.coalesce(minify_json(content), T.canonical_space(content))).otherwise(T.canonical_space(content))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_PATHS)


def signal_terms(terms: Column, concepts: Column, most: int = 40) -> Column:
    """The longest signals, of 4 to 63 characters, of a prompt's terms and concepts (null: none): each with the spellings of its stem, without a
    file ending, and its parts of five characters or more. Weak words give none. Ties: in order of the text."""
    none = F.array().cast("array<string>")
    given = F.filter(F.transform(F.coalesce(terms, none), lambda t: F.trim(t)), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*WEAK_SIGNALS))
    base = lambda t: F.regexp_replace(F.regexp_extract(t, r"([^/\\]*)$", 1), rf"(?i){ENDINGS}", "")
    parts = lambda t: F.filter(F.split(t, r"(?=[A-Z])|[\s_.-]+"), lambda p: F.length(p) >= 5)
    made = F.flatten(F.transform(given, lambda t: F.concat(F.array(t, base(t)), T.stem_variants(base(t)), parts(base(t)))))
    all_ = F.array_distinct(F.concat(made, F.filter(F.transform(F.coalesce(concepts, none), lambda c: F.trim(c)), lambda c: c != "")))
    fine = F.filter(all_, lambda x: F.length(x).between(4, 63) & ~F.lower(x).isin(*WEAK_SIGNALS))
    return F.slice(F.transform(F.array_sort(F.transform(fine, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]), 1, most)


def counted(tokenizer, texts: list[str]) -> list[int]:
    """Tokens of each text. Texts are encoded ENCODED characters at a time, since what an encoding holds is many times its text."""
    out, begin = [], 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= ENCODED:
            size, end = size + len(texts[end]), end + 1
        out += [len(x.ids) for x in tokenizer.encode_batch(texts[begin:end], add_special_tokens=False)]
        begin = end
    return out


def exact_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of each text by a tokenizers file, instead of the estimate; null: 0."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = Tokenizer.from_file(tokenizer)
        return pd.Series(counted(_TOKENIZERS[tokenizer], [x or "" for x in s]), dtype="int64")

    return run(text)


_TOKENIZERS: dict = {}
#: Characters of the texts that are encoded at once.
ENCODED = 1 << 18
