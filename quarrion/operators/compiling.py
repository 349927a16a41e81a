"""Compiling hits into a context within a token budget."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.config import Config
from quarrion.functions import text as T
from quarrion.operators import packing
from quarrion.operators.common import top

LAYER_ORDER = ("session", "repo", "workspace", "global")


def tokens(text: str) -> int:
    """The estimate of quarrion.functions.text.token_estimate, of a string."""
    n = len(text)
    return math.ceil(n / (4.5 - min(len(re.findall(packing.CODE, text)) / max(n, 1), 0.5) * 3)) if n else 0


def primaries(hits: DataFrame, per_file: int = 2, total: int = 5) -> DataFrame:
    """The leading hits by column lead: at most per_file of a file and total in all, with their rank."""
    return top(top(hits, ["prompt_id", "source_file"], [F.desc("lead"), "id"], per_file), ["prompt_id"], [F.desc("lead"), "id"], total, "rank")


def lead_scores(hits: DataFrame) -> DataFrame:
    """hits with lead: the score over the prompt's best, plus what the signal terms and names say.

    Needs coverage (share of terms in the text), named, stem_match (booleans) and fits (boolean).
    """
    from pyspark.sql.window import Window

    best = F.greatest(F.max("score").over(Window.partitionBy("prompt_id")), F.lit(1e-9))
    lead = F.col("score") / best + 1.5 * F.col("coverage") + F.col("named").cast("double") + 0.5 * F.col("stem_match").cast("double") - 0.4 * (~F.col("fits")).cast("double")
    return hits.withColumn("lead", lead)


#: Prompts that ask how something works (fixed patterns).
IMPLEMENTATION = (r"(how|what) does .* (work|function|do)", r"(explain|describe) .* implementation", r"how is .* implemented")


def tier(hits: DataFrame, intents: DataFrame) -> DataFrame:
    """(prompt_id, tier) from the five best hits(prompt_id, id, source_file, symbol_name, score) and intents(prompt_id, prompt, identifiers, concepts).

    An identifier that is the symbol of a hit of 10 or more: exact, or exact-implementation if the prompt asks how it works. Else
    file, if the stem of a hit of 5 or more is among the concepts; else explore.
    """
    best = top(hits, ["prompt_id"], [F.desc("score"), "id"], 5).select("prompt_id", "source_file", "symbol_name", "score").join(intents, "prompt_id")
    stem = F.split_part(F.regexp_extract("source_file", r"([^/\\]*)$", 1), F.lit("."), F.lit(1))
    named = (F.coalesce("symbol_name", F.lit("")) != "") & F.array_contains("identifiers", F.coalesce("symbol_name", F.lit(""))) & (F.col("score") >= 10)
    asks = F.lit(False)
    for p in IMPLEMENTATION:
        asks = asks | F.col("prompt").rlike(f"(?i){p}")
    per = best.groupBy("prompt_id").agg(F.max(named).alias("e"), F.max(F.array_contains("concepts", stem) & (F.col("score") >= 5)).alias("f"), F.max(asks).alias("i"))
    return per.select("prompt_id", F.when(F.col("e") & F.col("i"), "exact-implementation").when(F.col("e"), "exact").when(F.col("f"), "file").otherwise("explore").alias("tier"))


def common_folder(files: Column) -> Column:
    """The folder that all of the (distinct) paths lie in: what the least and the largest have in common."""
    part = lambda c: F.split(c, "/")
    a, b = part(F.array_min(files)), part(F.array_max(files))
    n = F.least(F.size(a), F.size(b)) - 1
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k))
    return F.array_join(F.slice(a, F.lit(1), F.array_max(same)), "/")


def compiled(hits: DataFrame, prompts: DataFrame, cfg: Config | None = None, budget: int | None = None, form: str = "markdown") -> DataFrame:
    """(prompt_id, output, tokens, n_body, n_excerpt, n_stub): one rendering a prompt, as markdown or xml, within the budget.

    hits: prompt_id, id, source_file, layer, line, content, score and, where there are any, symbol_name, symbol_kind, parent_symbol,
    section_title, sent (boolean); bounded a prompt by the final cap. prompts: prompt_id, terms (identifiers and words) and, where there
    are any, identifiers. Markdown has layers in their order, neighbours of one file under one heading, a long common folder named
    once, and at most three stubs; xml has whole elements.
    """
    cfg = cfg or Config()
    most = budget or cfg.max_token_budget
    inner = max(min(380, most), most - cfg.framing_reserve)

    def some(df: DataFrame, **kinds: str) -> list:
        return [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]

    names = {c: "string" for c in ("symbol_name", "symbol_kind", "parent_symbol", "section_title")}
    rows = hits.select("prompt_id", "id", "source_file", "layer", F.col("line").cast("int").alias("line"), "content", "score", *some(hits, **names, sent="boolean"))
    asked = prompts.select("prompt_id", "terms", F.coalesce(*some(prompts, identifiers="array<string>"), F.array().cast("array<string>")).alias("identifiers"))
    placed = packing.ordered(rows, asked, inner)
    path, xml = F.col("source_file"), form == "xml"
    frame = F.length("source_file") + (F.length("layer") + 52 if xml else 4)
    h = packing.chosen(placed, inner, F.ceil(frame / 3))
    text = F.when(F.col("form") == "body", F.col("content")).when(F.col("form") == "excerpt", packing.excerpt(F.col("content"), F.col("_terms"), F.col("most"))).otherwise(packing.stub())
    h = h.withColumn("text", text)
    if xml:
        name = F.when(F.col("form") == "stub", "more").otherwise("chunk")
        body = F.when(F.col("form") == "stub", T.escape_xml(F.col("text"))).otherwise(F.concat(F.lit("<![CDATA["), F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")))
        piece = F.concat(F.lit("<"), name, F.lit(' path="'), T.escape_xml(path), F.lit('" layer="'), T.escape_xml(F.col("layer")), F.lit('">'), body, F.lit("</"), name, F.lit(">"))
    else:
        piece = F.when(F.col("form") == "stub", F.col("text")).otherwise(F.concat(F.lit("## "), path, F.lit("\n"), "text"))
    around = "<context>\n</context>" if xml else "## More\n"
    kept = packing.within(h.withColumn("piece", piece), most, len(around), sum(c in "<>" for c in around))
    layer = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, name in enumerate(LAYER_ORDER) for x in (name, i))), F.col("layer")), F.lit(len(LAYER_ORDER)))
    item = F.struct((F.col("form") == "stub").alias("late"), layer.alias("l"), "place", "source_file", "text", "piece", "form")
    count = lambda k: F.sum((F.col("form") == k).cast("long")).alias(f"n_{k}")
    per = kept.groupBy("prompt_id").agg(F.array_sort(F.collect_list(item)).alias("items"), *map(count, ("body", "excerpt", "stub")))
    out = F.concat(F.lit("<context>\n"), F.array_join(F.transform("items", lambda x: F.concat(x["piece"], F.lit("\n"))), ""), F.lit("</context>")) if xml else _markdown(F.col("items"))
    per = per.withColumn("output", out)
    return per.select("prompt_id", "output", T.token_estimate(F.col("output")).alias("tokens"), "n_body", "n_excerpt", "n_stub")


def _markdown(items: Column) -> Column:
    full = F.filter(items, lambda x: ~x["late"])
    stubs = F.transform(F.filter(items, lambda x: x["late"]), lambda x: x["text"])
    files = F.array_distinct(F.transform(full, lambda x: x["source_file"]))
    folder = F.when(F.size(files) > 2, common_folder(files)).otherwise("")
    alias = (folder != "") & (F.length(folder) * F.size(files) > F.length(folder) + 12)
    short = lambda p: F.when(alias, F.concat(F.lit("~"), F.substring(p, F.length(folder) + 1, F.length(p)))).otherwise(p)
    head = lambda x, i: F.when((i > 0) & (F.get(full, i - 1)["source_file"] == x["source_file"]) & (F.get(full, i - 1)["l"] == x["l"]), x["text"]).otherwise(F.concat(F.lit("## "), short(x["source_file"]), F.lit("\n"), x["text"]))
    named = F.when(alias, F.array(F.concat(F.lit("`~` = "), folder))).otherwise(F.array().cast("array<string>"))
    more = F.when(F.size(stubs) > 0, F.concat(F.array(F.lit("## More")), stubs)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(named, F.transform(full, head), more), "\n")
