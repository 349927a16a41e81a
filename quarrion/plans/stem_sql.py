"""Porter's steps as table expressions for the oracle: measures are regular expressions over vowels and consonants."""

from __future__ import annotations

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M1, _M2 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_HAS = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_DOUBLE = "(" + "|".join(x * 2 for x in "bcdfghjkmnpqrtvwxy") + ")$"


def _cases(rules: list[tuple[str, str]], measure: str) -> str:
    """A CASE that applies the longest rule whose ending the word has, if the rest has the measure."""
    parts = []
    for tail, new in sorted(rules, key=lambda r: -len(r[0])):
        rest = f"left(w, length(w) - {len(tail)})"
        more = f" AND regexp_matches({rest}, '[st]$')" if tail == "ion" else ""
        parts.append(f"WHEN ends_with(w, '{tail}') THEN CASE WHEN regexp_matches({rest}, '{measure}'){more} THEN {rest} || '{new}' ELSE w END")
    return "CASE " + " ".join(parts) + " ELSE w END"


def stems(source: str) -> str:
    """Expressions that end in stems(word, stem), for the words of the table expression source(word)."""
    from quarrion.functions.stem import _FOUR, _THREE, _TWO

    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{_M1}') THEN left(w, length(w) - 1) ELSE w END"
        f" WHEN ends_with(w, 'ed') AND regexp_matches(left(w, length(w) - 2), '{_HAS}') THEN left(w, length(w) - 2) || '+'"
        f" WHEN ends_with(w, 'ing') AND regexp_matches(left(w, length(w) - 3), '{_HAS}') THEN left(w, length(w) - 3) || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN replace(w, '+', 'e') WHEN regexp_matches(rtrim(w, '+'), '{_DOUBLE}') THEN left(w, length(w) - 2)"
        f" WHEN regexp_matches(rtrim(w, '+'), '{_SHORT}') THEN replace(w, '+', 'e') ELSE rtrim(w, '+') END",
        f"CASE WHEN ends_with(w, 'y') AND regexp_matches(left(w, length(w) - 1), '{_HAS}') THEN left(w, length(w) - 1) || 'i' ELSE w END",
        _cases(_TWO, _M1),
        _cases(_THREE, _M1),
        _cases(_FOUR, _M2),
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(w, length(w) - 1), '{_M2}') OR regexp_matches(left(w, length(w) - 1), '{_ONE}') AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}')) THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{_M2}') THEN left(w, length(w) - 1) ELSE w END",
    ]
    # A first y is a consonant: it is written large meanwhile.
    out = [f"p0 AS (SELECT word, CASE WHEN starts_with(f, 'y') THEN 'Y' || substr(f, 2) ELSE f END AS w, regexp_matches(f, '^[a-z]{{3,}}$') AS plain, f FROM (SELECT DISTINCT word, strip_accents(word) AS f FROM {source}))"]
    out += [f"p{k + 1} AS (SELECT word, plain, f, {x} AS w FROM p{k})" for k, x in enumerate(steps)]
    out.append(f"stems AS (SELECT word, CASE WHEN plain THEN lower(w) ELSE f END AS stem FROM p{len(steps)})")
    return ",\n".join(out)
