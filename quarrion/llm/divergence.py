"""Quality rules: base counts, and distribution divergence from language references.

Native DataFrame functions only. References are learned from all documents: for each
language (null is one of its own) of at least ENOUGH words, whatever its share, the histogram of
character classes, and of its common words, those with at least 1/COMMON of its words. Up to LANGS
references, with at most COMMON words each, are broadcast; more are joined by shuffle.
A document is rejected if the Jensen-Shannon distance (base 2, 0 to 1) of its own
histogram from its language's exceeds a limit: for classes a constant, for words one that
allows for the noise of short texts. Documents under the guards' lengths aren't judged by them,
and those of a language with fewer words by neither.

Texts are read twice: once to count each language's words, once to count all else and to compare
words. What the second pass finds is written out, and the classes are compared from there. A filter, which
returns texts, counts the classes in a pass of their own instead of writing texts out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm import common as C

LANGS = 500
COMMON = 200
#: Words from which a language's histogram is stable: a word at the limit of the common ones is expected ten times.
ENOUGH = 10 * COMMON
#: Character classes besides blanks and all others; the first is the base rule's symbols.
CLASSES = ("#*$%&|<>", r"\p{Lu}", "0-9", r".,;:!?'\"()\-")
#: Limits: of the class distance; of the word distance at infinite length, and what it gains by 1 / sqrt(words).
CLASS_LIMIT = 0.30
WORD_LIMIT, WORD_SLACK = 0.19, 1.0
#: Guards: fewest characters for the class rule, fewest words for the word rule (the base rule asks for 50 itself).
CLASS_CHARS, WORD_WORDS = 200, 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice.

    Windows are compared by 64-bit hash. Where no hash repeats, as mostly, that is all.
    Else (hash, place) pairs are sorted, so that equal windows are neighbours, and the
    places of those that have an equal neighbour are swept in order: each covers as many new
    words as it lies beyond the one before, three at most.
    """

    def covered(pairs: Column) -> Column:
        same = F.filter(pairs, lambda e, k: F.get(pairs, k - 1)["h"].eqNullSafe(e["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(e["h"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-10).alias("last"))
        return F.aggregate(
            F.sort_array(F.transform(same, lambda e: e["i"])),
            start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, windows))

    return let(words, of).cast("long")


def _lang() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("~"))


def _few(refs: DataFrame) -> DataFrame:
    """refs, a row a language, with a broadcast hint if there are LANGS at most."""
    return F.broadcast(refs) if refs.limit(LANGS + 1).count() <= LANGS else refs.hint("merge")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def class_counts(text: Column, words: Column) -> Column:
    """Characters by class, then blanks, then others. Runs of other characters are cut out, and what is left is counted."""
    found = [F.char_length(F.regexp_replace(text, f"[^{c}]++", "")).cast("long") for c in CLASSES]
    blanks = (F.char_length(text) - F.char_length(F.array_join(words, ""))).cast("long")
    return let(F.array(*found, blanks), lambda x: F.concat(x, F.array(F.greatest(F.char_length(text) - F.aggregate(x, F.lit(0).cast("long"), lambda t, y: t + y), F.lit(0)))))


def word_references(docs: DataFrame) -> DataFrame:
    """lang, n (words), common (words by code point) and shares, of all docs(text, lang); none for languages of fewer than ENOUGH words."""
    words = docs.select(_lang().alias("lang"), F.explode(F.split(C.text_of(), C.BLANK)).alias("w")).where("w <> ''").groupBy("lang", "w").count()
    words = C.cut(words, "words")
    per = words.groupBy("lang").agg(F.sum("count").alias("n")).where(F.col("n") >= ENOUGH)
    often = words.join(_few(per), "lang").where(F.col("count") * COMMON >= F.col("n"))
    tops = often.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("w", (F.col("count") / F.col("n")).alias("p")))).alias("top"))  # COMMON rows a language at most
    none = F.array().cast("array<struct<w: string, p: double>>")
    top = per.join(tops, "lang", "left").withColumn("top", F.coalesce("top", none))
    return C.cut(top.select("lang", "n", F.transform("top", lambda x: x["w"]).alias("common"), F.transform("top", lambda x: x["p"]).alias("shares")), "word-references")


def class_references(rows: DataFrame) -> DataFrame:
    """lang and classes (shares), of rows(lang, classes)."""
    sums = rows.groupBy("lang").agg(*(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)))
    counts = F.array(*(F.col(f"c{i}").cast("double") for i in range(len(CLASSES) + 2)))
    return C.cut(sums.select("lang", let(counts, lambda x: let(F.greatest(_sum(x), F.lit(1.0)), lambda n: F.transform(x, lambda y: y / n))).alias("classes")), "class-references")


def _part(a: Column, m: Column) -> Column:
    return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)


def _both(p: Column, q: Column) -> Column:
    """A cell's share of twice the Jensen-Shannon divergence."""
    return let(F.struct(p.alias("p"), q.alias("q")), lambda z: _part(z["p"], (z["p"] + z["q"]) / 2) + _part(z["q"], (z["p"] + z["q"]) / 2))


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, base 2, of counts (normalised here) from shares; 0 where there are no counts."""

    def of(pair: Column) -> Column:
        n = _sum(pair["a"])
        both = let(n, lambda t: F.zip_with(pair["a"], pair["b"], lambda a, b: _both(a / t, b)))
        return F.when(n <= 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(_sum(both) / 2, F.lit(0.0))))

    return let(F.struct(counts.cast("array<double>").alias("a"), shares.alias("b")), of)


def word_distance(words: Column, common: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a document's words from its language's: cells are the common words and all others.

    Common words that don't occur add their share; those that do are found by a set operation, and counted by their
    first and last place in the sorted words.
    """

    def of(s: Column) -> Column:
        n = F.size(s["up"])

        def cell(w: Column) -> Column:
            k = n + 2 - F.array_position(s["up"], w) - F.array_position(s["down"], w)
            return F.struct((k / n).alias("p"), F.get(shares, (F.array_position(common, w) - 1).cast("int")).alias("q"))

        def total(cells: Column) -> Column:
            p, q = _sum(F.transform(cells, lambda c: c["p"])), _sum(F.transform(cells, lambda c: c["q"]))
            here = _sum(F.transform(cells, lambda c: _both(c["p"], c["q"])))
            all_q = _sum(shares)
            rest = _both(F.greatest(1 - p, F.lit(0.0)), F.greatest(1 - all_q, F.lit(0.0)))
            return F.sqrt(F.greatest((here + F.greatest(all_q - q, F.lit(0.0)) + rest) / 2, F.lit(0.0)))

        return let(F.transform(F.array_intersect(common, s["up"]), cell), total)

    return let(F.sort_array(words), lambda up: let(F.struct(up.alias("up"), F.reverse(up).alias("down")), of))


def measured(docs: DataFrame, keep: list[Column], name: str) -> DataFrame:
    """The columns `keep` of docs(text, lang), in a struct column `name` all that the rules rest on but the class distance, and a row number.

    The optimizer would push a filter on the verdict below the projections that it rests on, and so compute them more than once;
    it pushes none through a projection with a column that isn't deterministic and is used above, as the number is.
    """
    refs = F.struct("common", "shares").alias(f"{name}_ref")
    known = _few(word_references(docs.select("text", "lang")).select(F.col("lang").alias(f"{name}_lang"), refs))
    text, words = F.col(f"{name}_text"), F.col(f"{name}_words")
    d = docs.withColumns({f"{name}_text": C.text_of(), f"{name}_lang": _lang()})
    d = d.withColumn(f"{name}_words", F.filter(F.split(text, C.BLANK), lambda x: x != ""))
    d = d.join(known, f"{name}_lang", "left")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(C.WORD))
    n = F.size(words).cast("long")
    counts = {
        "lang": F.col(f"{name}_lang"),
        "n_words": n,
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "classes": class_counts(text, words),
        "known": F.col(f"{name}_ref").isNotNull(),
        "word_distance": F.when(F.col(f"{name}_ref").isNotNull() & (n >= WORD_WORDS), let(F.col(f"{name}_ref"), lambda r: word_distance(words, r["common"], r["shares"]))),
    }
    return d.select(*keep, F.struct(*(v.alias(k) for k, v in counts.items())).alias(name), F.monotonically_increasing_id().alias(f"{name}_row"))


def judged(rows: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """rows, from measured(), with n_symbols, base_failed, class_distance and kept added to the struct column `name`; refs: class_references()."""
    m = F.col(name)
    d = rows.join(_few(refs.select(F.col("lang").alias(f"{name}_lang"), F.col("classes").alias(f"{name}_ref"))), m["lang"] == F.col(f"{name}_lang"), "left")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    chars = F.aggregate(m["classes"], F.lit(0).cast("long"), lambda t, x: t + x)
    by_class = F.when(~failed & m["known"] & (chars >= CLASS_CHARS), js_distance(m["classes"], F.col(f"{name}_ref")))
    by_word = F.when(~failed, m["word_distance"])
    fine = (F.coalesce(by_class, F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce(by_word, F.lit(0.0)) <= WORD_LIMIT + WORD_SLACK / F.sqrt(m["n_words"]))
    new = m.withField("n_symbols", F.get(m["classes"], F.lit(0))).withField("base_failed", failed).withField("class_distance", by_class).withField("word_distance", by_word).withField("kept", ~failed & fine)
    return d.withColumn(name, new).drop(f"{name}_lang", f"{name}_ref")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and word_distance of documents(doc_id, text, lang).

    Null text: no words, so it fails the base rules. Distances are null where a guard's length isn't reached, where the
    base rules fail, and where the language has too few words for a reference; that rule then passes. Null ids and
    repeated rows are judged like others, an empty table gives an empty result, and other columns aren't read.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    rows = C.cut(measured(docs.select("doc_id", "text", "lang"), [F.col("doc_id")], "_m"), "measured")  # without the texts
    d = judged(rows, class_references(rows.select("_m.lang", "_m.classes")), "_m")
    return d.select("doc_id", *(F.col("_m")[x].alias(x) for x in names))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs(text, lang and any others) that pass, with docs' columns, whatever their names.

    Cases are as in scores(): null texts go, repeated rows share a fate, an empty table stays empty.
    """
    name = C.free_name(docs, "_m")
    text = C.text_of()
    words = F.filter(F.split(text, C.BLANK), lambda x: x != "")
    refs = class_references(docs.select(_lang().alias("lang"), let(words, lambda w: class_counts(text, w)).alias("classes")))
    d = judged(measured(docs, C.same_columns(docs), name), refs, name)  # not written out, as that would be all texts again
    return d.where(F.col(name)["kept"] & (F.col(f"{name}_row") >= 0)).select(*C.same_columns(docs))
