"""What the training-data operators share: the shared folder, cut lineage, table access, batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut, drop_cut, hot_join, shared_dir, small  # noqa: F401 - one place for the operators

#: ASCII white space that separates words, as a character class for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copies_apart(df: DataFrame, key: str, name: str, most: int = 10_000) -> DataFrame:
    """df with a column `name`: 0, but different numbers from 0 on for the rows of a key that more than `most` rows share.

    Such rows are alike, and any of them may have any of the numbers; the numbers let them be dealt out. They are counted
    by the tasks that hold them, so no task sees a key's rows together, and are written once, so that a lost task can't
    number them differently.
    """
    hot = cut(df.groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") > most).select(key), "hot")  # a most-th of the rows at most
    if hot.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    placed = cut(df.join(F.broadcast(hot), key, "left_semi").withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "copies")
    counts = placed.groupBy(key, "_task").agg(F.count("*").alias("_c"))
    ahead = counts.select(key, "_task", (F.sum("_c").over(Window.partitionBy(key).orderBy("_task")) - F.col("_c")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(key, "_task").orderBy("_at")) - 1
    apart = placed.withColumn("_own", own).join(F.broadcast(ahead), [key, "_task"]).withColumn(name, (F.col("_ahead") + F.col("_own")).cast("long"))
    rest = df.join(F.broadcast(hot), key, "left_anti").withColumn(name, F.lit(0).cast("long"))
    return rest.unionByName(apart.select(*rest.columns))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blocks_of(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cuts a list into runs of about `most` bytes in all; a longer text is a run of its own."""
    at = size = 0
    for i, x in enumerate(texts):
        if i > at and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches; at the end the worker, which may wait idle for a later stage, gives back what it no longer uses."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()


def release() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
