"""A stored index of names by their trigrams, for prefixes and parts of names.

A name's start counts as a character of its own, so that prefixes have grams of their own. A search probes one gram: the
rarest of those in the term, by the index's counts. Names that match are then compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators.common import small, stored

START, GRAM = "\x02", 3


def grams(c: Column) -> Column:
    """Distinct trigrams; none for shorter strings."""
    n = F.length(c) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(c, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass
class Names:
    """pairs (gram, name), sorted by gram; counts (gram, n)."""

    pairs: DataFrame
    counts: DataFrame

    def probed(self, terms: DataFrame, prefix: bool = False) -> DataFrame:
        """terms(term, ...) with the names that hold the term or, with prefix, begin with it. Terms of under three characters (two) match nothing.

        A term's names are those of its rarest gram; where a gram is in no name at all, neither is the term.
        """
        t = F.concat(F.lit(START), F.col("term")) if prefix else F.col("term")
        wanted = terms.select("term").distinct().select("term", F.explode(grams(t)).alias("gram"))
        known = wanted.join(self.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rare = known.groupBy("term").agg(F.min(F.struct("n", "gram")).alias("r")).where("r.n > 0").select("term", F.col("r.gram").alias("gram"))
        match = F.startswith("name", F.col("term")) if prefix else F.contains("name", F.col("term"))
        return terms.join(self.pairs.join(small(rare), "gram").where(match).select("term", "name"), "term")


def index(rows: DataFrame, folder: str | None = None) -> Names:
    """The index of rows(name), written to folder if one is given. Null names aren't in it."""
    found = rows.where("name is not null").select("name").distinct()
    pairs = found.select(F.explode(grams(F.concat(F.lit(START), F.col("name")))).alias("gram"), "name")
    if folder is None:
        pairs = stored(pairs)
        return Names(pairs, stored(pairs.groupBy("gram").agg(F.count("*").alias("n"))))
    pairs.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.parquet(f"{folder}/pairs")
    pairs = rows.sparkSession.read.schema("gram string, name string").parquet(f"{folder}/pairs")
    pairs.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{folder}/counts")
    return Names(pairs, rows.sparkSession.read.schema("gram string, n long").parquet(f"{folder}/counts"))


def passing(rows: DataFrame) -> Names:
    """The same of rows(name) for a few probes: distinct names are stored, and each probe makes their grams anew."""
    found = stored(rows.where("name is not null").select("name").distinct())
    pairs = found.select(F.explode(grams(F.concat(F.lit(START), F.col("name")))).alias("gram"), "name")
    return Names(pairs, stored(pairs.groupBy("gram").agg(F.count("*").alias("n"))))
