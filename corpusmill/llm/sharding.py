"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters rows by a seeded hash into buckets that fit in memory; pass 2 shuffles each bucket (Fisher-Yates, seeded
by the bucket) and lays the buckets end to end. A row's place in that order gives its shard (place modulo shards) and its
slot (place div shards), so counts of shards differ by one at most (law `rows`), whatever the sizes or copies are.

Defined cases. Null text: size 1. Null or repeated doc_id: the text is part of the hash. Rows with equal id and text share a
bucket, but where many do (hot_rows) each copy has a number in the hash and they are dealt out like others. Equal texts of
different ids are spread like all rows. Very long texts: a bucket holds at least one row. Empty table: no rows. Columns of the
input that are named like the added ones stay, and the added ones get an underscore before their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import copies_apart, cut, free_name, small, table

SEED = 20_231


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n); NumPy's permutation is the Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def prefix(counts: DataFrame, bucket: str, offset: str, run: int = 4096) -> DataFrame:
    """(bucket, offset): how many rows the buckets before hold; in runs of buckets, so that no task sums up all."""
    runs = counts.withColumn("run", F.floor(F.col(bucket) / run))
    sums = runs.groupBy("run").agg(F.sum("n").alias("r"))  # a row for each run
    before = sums.select("run", (F.sum("r").over(Window.orderBy("run")) - F.col("r")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("run").orderBy(bucket)) - F.col("n")
    return runs.withColumn("own", own).join(F.broadcast(before), "run").select(bucket, (F.col("before") + F.col("own")).alias(offset))


def external_shuffle(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = SEED,
    bucket_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_rows: int = 10_000,
) -> DataFrame:
    """docs with three more columns, `shard` (0 to n_shards - 1), `slot` (gapless from 0 in its shard) and `place`.

    The rows come out in their new order within each bucket; write them partitioned by shard, sorted by slot, or feed them
    on. One bucket is held in a task at a time: bucket_bytes of text at most on average, whatever the table's size. The
    texts are read twice: once for the sizes of the buckets, once for the shuffle.
    """
    spark = docs.sparkSession
    bucket, offset, key, copy = (free_name(docs, n) for n in ("bucket", "offset", "key", "copy"))
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    each = cut(keyed.groupBy(key).agg(F.count("*").alias("n"), F.max(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).alias("b")), "keys")
    total, most = each.agg(F.sum(F.col("n") * F.col("b")), F.max("n")).first()
    n_buckets = max(math.ceil((total or 0) / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda c: F.pmod(F.xxhash64(F.lit(seed), key, c), F.lit(n_buckets)).cast("int")
    if (most or 0) > hot_rows:
        keyed = copies_apart(keyed, key, copy, hot_rows)
        many = each.where(F.col("n") > hot_rows).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(copy), F.lit(1).cast("long").alias("n"))
        each = each.where(F.col("n") <= hot_rows).select(key, F.lit(0).cast("long").alias(copy), "n").unionByName(many)
    else:
        keyed, each = keyed.withColumn(copy, F.lit(0).cast("long")), each.withColumn(copy, F.lit(0).cast("long"))
    keyed = keyed.withColumn(bucket, dealt(F.col(copy))).drop(key, copy)
    counts = cut(each.groupBy(dealt(F.col(copy)).alias(bucket)).agg(F.sum("n").alias("n")), "buckets")
    offsets = small(prefix(counts, bucket, offset))
    added = [T.StructField(free_name(docs, n), t) for n, t in (("shard", T.IntegerType()), ("slot", T.LongType()), ("place", T.LongType()))]
    schema = T.StructType([*docs.schema.fields, *added])

    def shuffled(rows: pa.Table) -> pa.Table:
        start, b = rows.column(offset)[0].as_py(), rows.column(bucket)[0].as_py()
        rows = rows.drop_columns([bucket, offset])
        # the order of arrival may differ from run to run, so first a fixed order
        rows = rows.take(pc.sort_indices(rows.select([id_col, text_col]), sort_keys=[(id_col, "ascending"), (text_col, "ascending")]))
        rows = rows.take(pa.array(fisher_yates(len(rows), seed * 1_000_003 + b)))
        place = start + np.arange(len(rows), dtype=np.int64)
        for field, x in zip(added, (pa.array((place % n_shards).astype(np.int32)), pa.array(place // n_shards), pa.array(place)), strict=True):
            rows = rows.append_column(field.name, x)
        return rows

    return keyed.join(offsets, bucket).groupBy(bucket).applyInArrow(shuffled, schema)


def op1_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
