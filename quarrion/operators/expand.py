"""Windows of lines around terms, for requests that name files: budgets in estimated tokens a file and a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.operators.common import top

#: Bytes of a file, files and terms a request, characters a term and a line, lines around a match.
FILE_BYTES, PATHS, TERMS, TERM_CHARS, LINE_CHARS, AROUND_MOST = 2 << 20, 32, 64, 256, 64 << 10, 200
#: Tokens a file and a request.
FILE_TOKENS, REQUEST_TOKENS = 2000, 8000
GAP = "\n// ...\n\n"


def tokens(chars: Column, signs: Column) -> Column:
    """functions.text.token_estimate by counts of characters and of signs; it never falls when text is added."""
    dense = F.least(signs / F.greatest(chars, F.lit(1)), F.lit(0.5))
    return F.ceil(chars / (F.lit(4.5) - dense * 3)).cast("long")


def lines_around(files: DataFrame, terms: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """(request, path, line, piece, used): of files(request, path, text), the lines within `before` and `after` of one that holds a term.

    terms(request, term, k): the first TERMS of a request count, to TERM_CHARS characters, whatever their case. piece: the line, to LINE_CHARS
    characters, with its end, and after GAP where lines were left out before it. used: estimated tokens of the file's pieces so far. Lines are numbered from 0.
    """
    before, after = (min(max(x, 0), AROUND_MOST) for x in (before, after))
    few = top(terms.where("term is not null"), ["request"], ["k", "term"], TERMS)
    asked = few.groupBy("request").agg(F.collect_set(F.lower(F.substring("term", 1, TERM_CHARS))).alias("_terms"))
    each = files.join(asked, "request").select("request", "path", "_terms", F.posexplode(F.split("text", "\n", -1)).alias("line", "_l"))
    low = F.lower("_l")
    each = each.select("request", "path", "line", F.substring("_l", 1, LINE_CHARS).alias("_l"), F.when(F.exists("_terms", lambda t: F.contains(low, t)), F.col("line")).alias("_hit"))
    order = Window.partitionBy("request", "path").orderBy("line")
    last = F.last("_hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min("_hit").over(order.rowsBetween(0, before))
    near = each.withColumns({"_last": last, "_ahead": ahead}).where((F.col("line") - F.col("_last") <= after) | F.col("_ahead").isNotNull())
    piece = F.concat(F.when(F.lag("line").over(order) < F.col("line") - 1, F.lit(GAP)).otherwise(""), F.col("_l"), F.lit("\n"))
    near, so_far = near.withColumn("piece", piece), order.rowsBetween(Window.unboundedPreceding, 0)
    signs = F.regexp_count("piece", F.lit(r"[{}()\[\];=<>]"))
    return near.select("request", "path", "line", "piece", tokens(F.sum(F.length("piece")).over(so_far), F.sum(signs).over(so_far)).alias("used"))


def expanded(files: DataFrame, terms: DataFrame, before: int = 5, after: int = 5, file_tokens: int = FILE_TOKENS, request_tokens: int = REQUEST_TOKENS) -> DataFrame:
    """(request, path, place, status, content, tokens) of files(request, path, k, text) and terms(request, term, k).

    A request's first PATHS files by k take part, in that order, and each may use what those before it left of request_tokens, file_tokens at most; its lines go in
    whole, from the first, while they fit. status: whole; cut (lines didn't fit); no match; missing (text is null); too large
    (over FILE_BYTES); left out (nothing was left). A request without terms matches nothing. A path that is named twice counts once.
    """
    once = files.groupBy("request", "path").agg(F.min_by(F.struct("k", "text"), F.struct("k", F.col("text").isNull(), "text")).alias("_f")).select("request", "path", "_f.*")
    chosen = top(once, ["request"], ["k", "path"], PATHS, "place").select("request", "path", "place", "text", F.when(F.col("text").isNull(), "missing").when(F.octet_length("text") > FILE_BYTES, "too large").alias("why"))
    found = lines_around(chosen.where("why is null"), terms, before, after)
    room = F.col("used") <= min(file_tokens, request_tokens)
    kept = found.groupBy("request", "path").agg(F.sort_array(F.collect_list(F.when(room, F.struct("line", "used", "piece")))).alias("parts"), F.max(~room).alias("more"))
    state = F.struct("place", "path", "why", "parts", "more")
    each = chosen.drop("text").join(kept, ["request", "path"], "left").groupBy("request").agg(F.sort_array(F.collect_list(state)).alias("f"))  # PATHS files of a bounded text

    def step(s: Column, f: Column) -> Column:
        fits = F.filter(F.coalesce(f["parts"], F.array().cast("array<struct<line:int,used:bigint,piece:string>>")), lambda p: p["used"] <= s["left"])
        used = F.coalesce(F.array_max(F.transform(fits, lambda p: p["used"])), F.lit(0).cast("long"))
        status = F.when(s["left"] <= 0, "left out").when(f["why"].isNotNull(), f["why"]).when(f["parts"].isNull(), "no match").when(f["more"] | (F.size(fits) < F.size(f["parts"])), "cut").otherwise("whole")
        row = F.struct(f["path"].alias("path"), f["place"].alias("place"), status.alias("status"), F.array_join(F.transform(fits, lambda p: p["piece"]), "").alias("content"), used.alias("tokens"))
        return F.struct((s["left"] - used).alias("left"), F.array_append(s["out"], row).alias("out"))

    begin = F.struct(F.lit(request_tokens).cast("long").alias("left"), F.array().cast("array<struct<path:string,place:bigint,status:string,content:string,tokens:bigint>>").alias("out"))
    return each.select("request", F.inline(F.aggregate("f", begin, step)["out"]))
