"""Change detection, upserts, removals and small row-order helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.sources.store import Conflict, Snapshot, Store  # noqa: F401  part of this module's names


def changed(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, action) of files(path, hash) that are new or whose hash differs."""
    j = scanned.join(indexed.select("path", F.col("hash").alias("_h")), "path", "left")
    return j.where(~F.col("hash").eqNullSafe(F.col("_h"))).select("path", F.when(F.col("_h").isNull(), "add").otherwise("change").alias("action"))


def stale(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Indexed files that a complete scan didn't find."""
    return indexed.join(scanned.select("path"), "path", "left_anti")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def upserted(existing: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """existing with new rows in place of those of equal key; columns in keep hold their old value."""
    if keep:
        old = existing.select(*key, *(F.col(c).alias(f"_{c}") for c in keep))
        new = new.join(old, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).select(*existing.columns)
    return existing.join(new.select(*key), key, "left_anti").unionByName(new)


def removed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def unique_titles(rows: DataFrame, within: list[str], title: str, order: str) -> DataFrame:
    """Repeated titles get #dup1, #dup2 and so on, in order."""
    k = F.row_number().over(Window.partitionBy(*within, title).orderBy(order))
    return rows.withColumn("_k", k).withColumn(title, F.when(F.col("_k") > 1, F.concat(F.col(title), F.lit("#dup"), (F.col("_k") - 1).cast("string"))).otherwise(F.col(title))).drop("_k")


def merged_windows(rows: DataFrame, by: list[str], gap: int = 1) -> DataFrame:
    """(by, s, e): windows that overlap or lie within `gap` are one."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = rows.withColumn("_p", before).withColumn("_new", F.when(F.col("_p").isNull() | (F.col("s") > F.col("_p") + gap), 1).otherwise(0))
    x = x.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def line_range(text: Column, start: int, n: int, most: int = 2000) -> Column:
    """n lines from line `start` (from 1)."""
    return F.array_join(F.slice(F.split(text, "\n"), start, min(n, most)), "\n")


def lookup(rows: DataFrame, values: DataFrame | None = None, **equal) -> DataFrame:
    """rows by key: those whose columns equal the given values (a list: any of them), and that match values(one column or more) on its columns."""
    for column, value in equal.items():
        rows = rows.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column).eqNullSafe(F.lit(value)))
    return rows if values is None else rows.join(values.distinct(), list(values.columns), "left_semi")


def united(stores: dict[str, DataFrame]) -> DataFrame:
    """The rows of several stores, the first the nearest, with column store. Of rows with one id, the nearest store's stays."""
    out = None
    for k, (name, df) in enumerate(stores.items()):
        part = df.withColumns({"store": F.lit(name), "_near": F.lit(k)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    best = out.groupBy("id").agg(F.min("_near").alias("_near"))
    return out.join(best, ["id", "_near"], "left_semi").drop("_near")


def reconciled_after(indexed: DataFrame, scanned: DataFrame, completed: bool, failed: int = 0) -> DataFrame:
    """indexed without the files that a scan didn't find; as it was, if the scan didn't complete or any file failed."""
    return removed(indexed, stale(indexed, scanned), "path") if completed and not failed else indexed
