"""Shared pieces: the shared folder, cutting lineage, files that executors write, column hygiene."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local master gets a folder under /tmp; any other
    master is refused, because its executors could not see such a folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/quarrion-shared-{os.getuid()}"


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared root; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/quarrion/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost
    executor costs a re-read. Unlike checkpoint() it is columnar and computed once."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark, tag)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, when all that rests on it has been written."""
    spark = df.sparkSession
    for uri in df.inputFiles()[:1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri).getParent().getParent()
        if "/quarrion/" in where.toString():
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(uri: str):
    """(pyarrow file system, path) of a URI that Hadoop understands."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri[5:] if uri.startswith('file:') else uri}"
    if uri.startswith("s3a://"):
        uri = f"s3://{uri[6:]}"
    return fs.FileSystem.from_uri(uri)


class atomic_file:  # noqa: N801
    """Write a file beside its place and move it there at the end, so that a task that is
    run twice, or dies half way, never leaves a torn file."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


def free_name(df: DataFrame, stem: str) -> str:
    """stem, lengthened until no column of df begins with it (names are compared without case)."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem


def same_columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def a_task_each(df: DataFrame, key: str) -> DataFrame:
    """df with a partition for about each row, by key. It stays in the JVM: rows that come from a Python list would need a
    second Python worker beside each task's own."""
    return df.repartitionByRange(max(1, df.count()), key)


def hot_limit(rows: int) -> int:
    """A key with more rows than this is hot: there are under 100,000 such keys, whatever the number of rows."""
    return max(1000, rows // 100_000)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in a task for 20,000 of them, 16 at least: of few rows, a session's many shuffle partitions would each be all but empty
    and cost a task each. Of many, the session's partitions stay."""
    return df.coalesce(max(16, -(-rows // 20_000)))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left, left-joined with right, which has one row a key; null keys match nothing.

    hot(key, n): the keys of left that exceed hot_limit(), and their rows. Such a key's rows are dealt over as many pieces as
    hold the limit each, and right's row goes to all of them. hot is small by that limit, so it is broadcast.
    """
    limit = hot.agg(F.min("n")).first()[0]
    if limit is None:
        return left.join(right.hint("merge"), key, "left")
    pieces = F.broadcast(hot.select(F.col(key), F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("_pieces")))
    spread = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    many = right.join(pieces, key, "left").withColumn("_piece", F.explode(spread)).drop("_pieces")
    dealt = left.join(pieces, key, "left").withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_pieces")).cast("int"))).drop("_pieces")
    return dealt.join(many.hint("merge"), [key, "_piece"], "left").drop("_piece")


def slices(values: list, sizes: Iterable[int], most: int = 4 << 20) -> Iterator[slice]:
    """Slices of a batch whose sizes sum to about `most` at a time (one row at least)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(values):
        yield slice(begin, len(values))


def arrow(schema: str, spark: SparkSession | None = None) -> pa.Schema:
    """The Arrow schema of simple 'name type' pairs."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(","))])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
