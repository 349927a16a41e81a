"""Porter's stemmer, from the description in Program 14(3), 1980."""

from __future__ import annotations

import re

_VOWEL = "aeiou"
# Suffix rules of steps 2 to 4, longest match first; each applies if the measure of what stays is large enough.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted(((a, b) for a, _, b in (x.partition(":") for x in text.split())), key=lambda r: -len(r[0]))


_TWO, _THREE, _FOUR = _rules(_STEP2), _rules(_STEP3), _rules(_STEP4)
#: A word that ends in none of these is its own stem.
ENDS = ("s", "ed", "ing", "y", "e", "ll", *(tail for tail, _ in _TWO + _THREE + _FOUR))
_TAILS = {id(rules): tuple(tail for tail, _ in rules) for rules in (_TWO, _THREE, _FOUR)}


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in _VOWEL or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _has_vowel(w: str) -> bool:
    return "v" in _shape(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replace(w: str, rules: list[tuple[str, str]], least: int) -> str:
    if not w.endswith(_TAILS[id(rules)]):
        return w
    for tail, new in rules:
        if w.endswith(tail):
            rest = w[: len(w) - len(tail)]
            if _measure(rest) >= least and (tail != "ion" or rest[-1:] in ("s", "t")):
                return rest + new
            return w
    return w


def porter(w: str) -> str:
    """The stem of a lower-cased word; words that aren't plain letters, or of two letters, stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for tail in ("ed", "ing"):
            rest = w[: -len(tail)]
            if w.endswith(tail) and _has_vowel(rest):
                w = rest
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(_replace(w, _TWO, 1), _THREE, 1), _FOUR, 2)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def heads(stem: str) -> list[str]:
    """Of each word with this stem, one of these is the start: stemming cuts the word's end and changes what is left in its last letter alone, to i, e or (bility) l."""
    if len(stem) > 4:
        return [stem[:4]]
    if stem.endswith("i"):
        return [stem, stem[:-1] + "y"]
    return [stem[:-1]] if len(stem) > 2 and stem.endswith(("e", "l")) else [stem]
