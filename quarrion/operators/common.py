"""Small helpers that operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast up to so many rows and bytes; beyond, the planner joins by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a look at its rows shows that it's small enough. Strings and arrays count by their length, all else eight bytes."""
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(0))
    got = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= BROADCAST_ROWS and got.b <= BROADCAST_BYTES else df


def _width(kind, c: Column) -> Column:
    """Bytes of a value, about."""
    from pyspark.sql import types as K

    if isinstance(kind, K.StringType | K.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, K.ArrayType):
        each = lambda x: _width(kind.elementType, x)
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + each(x)), F.lit(0).cast("long"))
    if isinstance(kind, K.StructType):
        return sum((_width(f.dataType, c[f.name]) for f in kind), F.lit(0))
    return F.lit(8)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder, so that what follows doesn't repeat it and plans stay small."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut, and of known size, so that the planner
    broadcasts it in joins if it's small and shuffles it if it isn't. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = fresh_folder(spark, "stored")
    df.write.parquet(f"{path}/t")
    return spark.read.schema(df.schema).parquet(f"{path}/t")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared one that goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a local master, whose executors are
    the driver, gets one under /tmp; any other is refused."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file:///tmp/quarrion-checkpoints').rstrip('/')}/quarrion"


def top(df: DataFrame, by: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; rank: a column that numbers them from 0."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n)
    return ranked.withColumn(rank, (F.col("_rn") - 1).cast("long")).drop("_rn") if rank else ranked.drop("_rn")


def r6(x: Column, name: str) -> Column:
    return F.round(x.cast("double"), 6).alias(name)
