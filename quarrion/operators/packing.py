"""Fitting a prompt's hits into a budget of tokens, as columns.

A hit's place follows from its role and lead. A fold over a prompt's hits in that order (bounded by the final cut of its hits) decides
which stay whole, which are cut to their telling lines, and which are only named; a second one, over what is then to be written, keeps the sum within
the budget. All of it is built-in functions, so prompts run in parallel without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.functions import content as C
from quarrion.functions import text as T

GAP = "…"
#: The leader's share of the budget where others wait, the least that an excerpt is worth, most stubs, and what a line costs besides its own tokens.
LEAD_SHARE, TINY, STUBS, LINE = 0.65, 80, 3, 2
CODE = r"[{}()\[\];=<>]"


def tokens_of(n: Column, code: Column) -> Column:
    """The estimate of quarrion.functions.text.token_estimate, from a length and a number of code characters. It doesn't depend on their order."""
    share = F.least(code / F.greatest(n, F.lit(1)), F.lit(0.5))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.ceil(n / (F.lit(4.5) - share * 3)))


def judged(hits: DataFrame, prompts: DataFrame, budget: int) -> DataFrame:
    """hits with n (tokens), coverage, named, stem_match, touch, test and fits; prompts: prompt_id, terms and identifiers (lower case)."""
    h = hits.join(prompts.select("prompt_id", F.filter(F.transform("terms", lambda t: F.lower(t)), lambda t: F.length(t) >= 4).alias("_terms"), F.transform("identifiers", lambda x: F.lower(x)).alias("_ids")), "prompt_id")
    low, symbol = F.lower("content"), F.lower(F.coalesce("symbol_name", F.lit("")))
    stem = F.regexp_replace(F.lower(F.regexp_extract("source_file", r"([^/\\]*)$", 1)), C.ENDINGS, "")
    return h.withColumns({
        "n": T.token_estimate(F.col("content")),
        "coverage": F.size(F.filter("_terms", lambda t: F.contains(low, t))) / F.greatest(F.size("_terms"), F.lit(1)),
        "named": F.coalesce((symbol != "") & F.array_contains("_ids", symbol), F.lit(False)),
        "stem_match": F.coalesce(F.array_contains("_terms", stem), F.lit(False)),
        "test": C.is_test_file(F.col("source_file")),
    }).withColumns({"touch": F.col("named") | F.col("stem_match") | (F.col("coverage") > 0), "fits": F.col("n") <= budget})


def ordered(hits: DataFrame, prompts: DataFrame, budget: int) -> DataFrame:
    """judged() hits with lead, role and place (from 1): the leader, what touches a signal in its file and then in others, its file, the rest, tests."""
    from quarrion.operators.compiling import lead_scores

    w = Window.partitionBy("prompt_id")
    h = lead_scores(judged(hits, prompts, budget))
    first = w.orderBy("test", F.desc("lead"), "id")
    h = h.withColumn("_k", F.row_number().over(first)).withColumn("_file", F.first("source_file").over(first))
    here = F.col("source_file") == F.col("_file")
    role = F.when(F.col("_k") == 1, 0).when(F.col("test"), 5).when(F.col("touch") & here, 1).when(F.col("touch"), 2).when(here, 3).otherwise(4)
    h = h.withColumn("role", role)
    return h.withColumn("place", F.row_number().over(w.orderBy("role", F.desc("lead"), "id"))).drop("_k", "_file")


def excerpt(content: Column, terms: Column, most: Column) -> Column:
    """The lines with a term, then the first and the others, as many as `most` tokens hold, in their order, gaps marked; else the text's beginning."""
    weight = lambda x, i: F.when(F.exists(terms, lambda t: F.contains(F.lower(x), t)), 0).when(i == 0, 1).otherwise(2)
    ranked = F.array_sort(F.transform(F.split(content, "\n"), lambda x, i: F.struct(weight(x, i).alias("w"), i.alias("i"), (T.token_estimate(x) + LINE).alias("n"), x.alias("x"))))
    start = F.struct(most.cast("long").alias("room"), F.array().cast("array<struct<i: int, x: string>>").alias("kept"))

    def take(s: Column, x: Column) -> Column:
        return F.when(x["n"] <= s["room"], F.struct((s["room"] - x["n"]).alias("room"), F.concat(s["kept"], F.array(F.struct(x["i"].alias("i"), x["x"].alias("x")))).alias("kept"))).otherwise(s)

    kept = F.array_sort(F.aggregate(ranked, start, take)["kept"])
    line = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("t"))
    grown = F.aggregate(kept, line, lambda s, x: F.struct(x["i"].alias("last"), F.concat(s["t"], F.when(x["i"] != s["last"] + 1, F.array(F.lit(GAP), x["x"])).otherwise(F.array(x["x"]))).alias("t")))
    text = F.array_join(grown["t"], "\n")
    return F.when(F.size(kept) > 0, text).otherwise(F.substring(content, F.lit(1), F.greatest(most * 3, F.lit(0)).cast("int")))


def stub() -> Column:
    """A line that says what is where."""
    path = F.array_join(F.slice(F.split("source_file", "/"), F.greatest(F.size(F.split("source_file", "/")) - 2, F.lit(1)), F.lit(3)), "/")
    lines = F.concat(F.lit(":"), F.col("line").cast("string"), F.lit("-"), (F.col("line") + F.regexp_count("content", F.lit("\n"))).cast("string"))
    symbol = F.when(F.coalesce("symbol_name", F.lit("")) != "", F.concat_ws(" ", F.coalesce("symbol_kind", F.lit("symbol")), "symbol_name"))
    name = F.coalesce(symbol, F.col("section_title"), F.regexp_extract("source_file", r"([^/\\]*)$", 1))
    return F.concat(name, F.lit(" — "), path, F.coalesce(lines, F.lit("")))


def chosen(placed: DataFrame, budget: int, overhead: Column) -> DataFrame:
    """placed hits with form (body, excerpt, stub) and most (an excerpt's tokens). overhead: what a hit's frame costs, in tokens.

    In order of place: what was sent before is named, but for the leader; what fits stays whole; what touches a signal is cut to the room that is
    left; a leader too large takes its share. A segment whose whole function is there is named only.
    """
    item = F.struct("place", "id", F.col("n").cast("long").alias("n"), overhead.cast("long").alias("o"), "touch", F.coalesce("sent", F.lit(False)).alias("sent"))
    per = placed.groupBy("prompt_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    lead = F.lit(int(LEAD_SHARE * budget)).cast("long")
    start = F.struct(F.lit(budget).cast("long").alias("room"), F.array().cast("array<struct<id: string, form: string, most: bigint>>").alias("out"))

    def decide(s: Column, x: Column) -> Column:
        first, room = F.size(s["out"]) == 0, s["room"] - x["o"]
        cut = F.when(first, F.greatest(F.least(lead, room), F.lit(1).cast("long"))).otherwise(room)
        form = F.when(~first & x["sent"], "stub").when(x["n"] <= room, "body").when(first | x["touch"] & (room > TINY), "excerpt").otherwise("stub")
        cost = F.when(form == "body", x["n"] + x["o"]).when(form == "excerpt", cut + x["o"]).otherwise(0)
        return F.struct((s["room"] - cost).alias("room"), F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), form.alias("form"), cut.alias("most")))).alias("out"))

    got = per.select("prompt_id", F.explode(F.aggregate("items", start, decide)["out"]).alias("d")).select("prompt_id", F.col("d.id").alias("id"), "d.form", "d.most")
    h = placed.join(got, ["prompt_id", "id"])
    whole = F.collect_set(F.when((F.col("form") == "body") & (F.coalesce("symbol_kind", F.lit("")) != "segment"), F.col("symbol_name"))).over(Window.partitionBy("prompt_id", "source_file"))
    inside = (F.col("symbol_kind") == "segment") & F.array_contains(whole, F.col("parent_symbol"))
    return h.withColumn("form", F.when(F.coalesce(inside, F.lit(False)), "stub").otherwise(F.col("form")))


def within(pieces: DataFrame, budget: int, frame: int, frame_code: int) -> DataFrame:
    """pieces(prompt_id, id, form, place, piece, ...) that the budget holds as they are written: bodies and excerpts by place, then STUBS stubs.
    frame, frame_code: length and code characters of what is written around all."""
    item = F.struct((F.col("form") == "stub").alias("late"), "place", "id", F.length("piece").cast("long").alias("n"), F.regexp_count("piece", F.lit(CODE)).cast("long").alias("c"))
    per = pieces.groupBy("prompt_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = lambda v, name: F.lit(v).cast("long").alias(name)
    start = F.struct(zero(frame, "n"), zero(frame_code, "c"), zero(0, "stubs"), F.array().cast("array<string>").alias("ids"))

    def take(s: Column, x: Column) -> Column:
        n, c = s["n"] + x["n"] + 1, s["c"] + x["c"]
        ok = (tokens_of(n, c) <= budget) & (~x["late"] | (s["stubs"] < STUBS))
        return F.when(ok, F.struct(n.alias("n"), c.alias("c"), (s["stubs"] + x["late"].cast("long")).alias("stubs"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s)

    kept = per.select("prompt_id", F.explode(F.aggregate("items", start, take)["ids"]).alias("id"))
    return pieces.join(kept, ["prompt_id", "id"], "left_semi")
