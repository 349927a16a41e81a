"""Ordered rows within groups: runs, sections, budgets, margins, and rows that stand for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _so_far(by: list, order: list):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def runs(rows: DataFrame, by: list, order: list, value: str, out: str = "run") -> DataFrame:
    """rows with the number, from 1, of the run of equal neighbours that each lies in. Nulls aren't equal."""
    new = F.when(F.lag(value).over(Window.partitionBy(*by).orderBy(*order)) == F.col(value), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(_so_far(by, order))).drop("_new")


def sections(rows: DataFrame, by: list, order: list, heading: Column, out: str = "section") -> DataFrame:
    """rows with the number of headings up to and with each; 0 before the first."""
    return rows.withColumn("_h", F.when(heading, 1).otherwise(0)).withColumn(out, F.sum("_h").over(_so_far(by, order))).drop("_h")


def within_budget(rows: DataFrame, by: list, order: list, cost: str, cap: int) -> DataFrame:
    """The first rows of each group whose costs sum to the cap at most; the first row in any case."""
    r = rows.withColumn("_used", F.sum(cost).over(_so_far(by, order))).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return r.where((F.col("_used") <= cap) | (F.col("_k") == 1)).drop("_used", "_k")


def margins(rows: DataFrame, by: list, score: str, *ties: str) -> DataFrame:
    """(by, margin): what the best of each group is ahead of the second, as a share of the best; null for a single row."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    best = rows.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_k = 1")
    return best.select(*by, ((F.col(score) - F.col("_next")) / F.col(score)).alias("margin"))


def missing_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(prompt_id, id) of the chunks that head the files of hits(prompt_id, id): a file's first line, where a later one was hit and it wasn't."""
    need = hits.join(chunks.where("line > 0"), "id").select("prompt_id", "source_file").distinct()
    return need.join(chunks.where("line = 0").select("source_file", "id"), "source_file").select("prompt_id", "id").distinct().join(hits.select("prompt_id", "id"), ["prompt_id", "id"], "left_anti")


def stale_by(files: DataFrame, changes: DataFrame, condition: Column) -> DataFrame:
    """files(path) with a change(path) for which the condition, over columns of both, holds."""
    return files.join(changes, "path").where(condition).select("path").distinct()
