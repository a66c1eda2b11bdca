"""What all parts share: the folder of the cluster, tables written there to cut lineage, joins that are sure to fit."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one in a local session, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/corpusmill-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", at)
        _remember(spark, at)
    return at.rstrip("/")


def _remember(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))


def _drop_written() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already; the files are scratch
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def cut(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so lost executors only cost a re-read.

    The files stay until the application ends (later reads need them) and are then deleted.
    """
    path = scratch(df.sparkSession, name)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*written: DataFrame) -> None:
    """Deletes tables that `cut` wrote and that nothing will read again."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            delete(df.sparkSession, folder)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def joined_in_blocks(rows: DataFrame, asked: DataFrame, on: Column | str | None, most: int = 10_000, how: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """rows with a stated set of queries or patterns, by any condition: `asked` goes to the rows in blocks of about `most` rows.

    One block is broadcast at a time, so memory doesn't grow with `asked`; each further block is one more pass over the rows.
    """
    n = max(1, math.ceil(asked.count() / most))
    if n == 1:
        return how(rows.join(F.broadcast(asked), on) if on is not None else rows.join(F.broadcast(asked)))
    block = F.pmod(F.xxhash64(*asked.columns), F.lit(n))
    parts = [asked.where(block == i) for i in range(n)]
    return reduce(DataFrame.unionByName, (how(rows.join(F.broadcast(p), on) if on is not None else rows.join(F.broadcast(p))) for p in parts))


def small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Broadcast, if its rows (measured as text, with a share for each row and cell) hold most_bytes at most; else as it is."""
    size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(c) if t in ("string", "binary") else F.col(c).cast("string")), F.lit(0)) + 8 for c, t in df.dtypes))
    return F.broadcast(df) if (df.agg(F.sum(size + 16).alias("b")).first()["b"] or 0) <= most_bytes else df


def hot_join(rows: DataFrame, unique: DataFrame, on: list[str], count: str, how: str = "inner", least: int = 1_000) -> DataFrame:
    """rows joined to `unique`, which has one row for each key and in column `count` how many of `rows` have it.

    A key may hold a third of all rows: keys with more rows than a task has on average (`least` at least) are broadcast with
    their row and joined where the rows are - there are no more of them than tasks -; the others are shuffled. `count` goes.
    """
    total, most = unique.agg(F.sum(count), F.max(count)).first()
    bound = max(least, (total or 0) // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if (most or 0) <= bound:
        return rows.join(unique.drop(count), on, how)
    hot, cold = unique.where(F.col(count) > bound).drop(count), unique.where(F.col(count) <= bound).drop(count)
    keys = F.broadcast(hot.select(*on))
    rest = rows.join(keys, on, "left_anti").join(cold, on, how)
    return rows.join(keys, on, "left_semi").unionByName(rest) if how == "left_semi" else rows.join(F.broadcast(hot), on).unionByName(rest)


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with the place of each row in the order, from 1, without any one task seeing all rows: ranges of the order are counted and numbered on their own."""
    part = "_part"
    ranged = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part).agg(F.count("*").alias("_c"))  # a row for each range
    ahead = counts.select(part, (F.sum("_c").over(Window.orderBy(part)) - F.col("_c")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(ahead), part).withColumn(name, (own + F.col("_ahead")).cast("long")).drop(part, "_ahead")
