"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's dimensions are cut into `lists` parts; each part is a score list, and a row's score is the sum over the lists.
Phase 1 gathers the k best entries of each list for every query, over one block of rows, and resolves them: the k-th best of
the whole scores met is a safe bound, whatever rows it comes from. Phase 2 gives every list the uniform cutoff bound / lists:
a row below it in all lists is below the bound, so the entries at or above it are sufficient. Phase 3 resolves the scores of
the rows that have one and keeps those that reach the bound; only they leave a task. So all rows are multiplied once, and one
block of them twice.

Queries and rows are dealt into blocks, and each pair of a query block and a row block is one task's matrix product, in
single precision where that is exact; lists of k entries are merged 64 at a time, so no task holds more than a block or 64
lists.

Components become floor(64 * x). Defined cases. Null vectors, vectors with a null or non-finite component and rows without
id take no part. Shorter vectors count as if zeros followed. Rows with an id that another row has: the least vector stands
for the id. Fewer candidates than k: all of them; ties go to smaller ids. Empty table: no rows. The result has the operator's
columns only, so no name of the input can clash. A product that could leave 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BEST = "best array<struct<score: long, minus_id: long>>"


def quantized(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """floor(64 * x) as whole numbers; shorter rows are filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.floor(64 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(x) for x in n]) if len(n) else []] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole-number products: in floating point while they are exact there, else in 64-bit integers."""
    bound = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**24:
        return (q.astype(np.float32) @ x.T.astype(np.float32)).astype(np.int64)
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores are, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def sufficient(partial: np.ndarray, bound: int | None) -> np.ndarray:
    """The rows with an entry at or above the uniform cutoff in any list. partial: lists x rows."""
    if bound is None:
        return np.arange(partial.shape[1])
    return np.flatnonzero((partial.max(axis=0) * len(partial)) >= bound)


def gathered(partial: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the k best entries of any list."""
    return np.unique(np.concatenate([best_rows(p, ids, k) for p in partial]))


def merged(lists: DataFrame, k: int, n_blocks: int, fan: int = 64) -> DataFrame:
    """(query_id, best): the k best of all row blocks' lists, `fan` at a time."""
    out = lists
    while True:
        n_blocks = math.ceil(n_blocks / fan)
        top = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
        out = out.groupBy("query_id", F.floor(F.col("rb") / fan).alias("rb")).agg(top)
        if n_blocks <= 1:
            return out.select("query_id", "best")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    lists: int = 4,
    row_block: int = 8192,
    query_block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows but itself. vectors, queries: (vec_id, embedding)."""
    spark = vectors.sparkSession
    sound = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    vectors = cut(vectors.where(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    queries = vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    n, dims = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n_qb = max(1, math.ceil(queries.count() / query_block))
    n_rb = max(1, math.ceil(n / row_block), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_qb))
    dims = max(1, dims or 1)
    edges = np.linspace(0, dims, lists + 1).astype(int)
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    rows = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("qb"), spread(n_rb).alias("rb"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("row"))

    def asked(extra: DataFrame | None, last: int) -> DataFrame:
        """Each query with its bound, if there is one yet, once for each of the row blocks 0 to `last`."""
        x = queries.withColumn("bound", F.lit(None).cast("long")) if extra is None else queries.join(extra.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        return x.select(spread(n_qb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("rb"), "vec_id", "embedding", "bound")

    def tiles(q: pa.Table, x: pa.Table) -> Iterator[tuple]:
        """Runs of queries with their partial scores in every list; the query's own row gets no place."""
        xs, ids = quantized(x.column("row"), dims), x.column("row_id").to_numpy()
        qs, names = quantized(q.column("embedding"), dims), q.column("vec_id").to_numpy()
        bounds = q.column("bound").to_pylist()
        step = max(1, (1 << 20) // max(1, len(ids)))
        for a in range(0, len(names), step):
            partial = np.stack([products(qs[a : a + step, e:f], xs[:, e:f]) for e, f in zip(edges[:-1], edges[1:], strict=True)])
            for i, name in enumerate(names[a : a + step].tolist()):
                others = np.flatnonzero(ids != name)
                yield name, bounds[a + i], partial[:, i, others], ids[others]

    def entries(found: list[tuple[int, int, list]]) -> pa.Table:
        names, blocks, best = zip(*found, strict=True) if found else ((), (), ())
        kind = pa.list_(pa.struct([("score", pa.int64()), ("minus_id", pa.int64())]))
        return pa.table({"query_id": pa.array(names, pa.int64()), "rb": pa.array(blocks, pa.int32()), "best": pa.array(best, kind)})

    def listed(total: np.ndarray, ids: np.ndarray) -> list:
        return [{"score": s, "minus_id": -i} for s, i in zip(total.tolist(), ids.tolist(), strict=True)]

    def phase1(key, q: pa.Table, x: pa.Table) -> pa.Table:
        found = []
        for name, _, partial, ids in tiles(q, x) if len(x) and len(q) else ():
            met = gathered(partial, ids, k)
            total = partial[:, met].sum(axis=0)
            at = best_rows(total, ids[met], k)
            found.append((name, key[1].as_py(), listed(total[at], ids[met][at])))
        return entries(found)

    def phase23(key, q: pa.Table, x: pa.Table) -> pa.Table:
        found = []
        for name, bound, partial, ids in tiles(q, x) if len(x) and len(q) else ():
            enough = sufficient(partial, bound)
            total = partial[:, enough].sum(axis=0)
            if bound is not None:
                enough, total = enough[total >= bound], total[total >= bound]
            if len(enough):
                at = best_rows(total, ids[enough], k)
                found.append((name, key[1].as_py(), listed(total[at], ids[enough][at])))
        return entries(found)

    def over_grid(asked_: DataFrame, of: DataFrame, f) -> DataFrame:
        return asked_.groupBy("qb", "rb").cogroup(of.groupBy("qb", "rb")).applyInArrow(f, f"query_id long, rb int, {BEST}")

    first = over_grid(asked(None, 0), rows.where("rb = 0"), phase1)
    bounds = cut(first.select("query_id", F.when(F.size("best") >= k, F.element_at("best", -1)["score"]).alias("bound")), "bounds")
    last = merged(over_grid(asked(bounds, n_rb - 1), rows, phase23), k, n_rb)
    out = last.select("query_id", F.posexplode("best").alias("i", "b"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), (-F.col("b.minus_id")).alias("vec_id"), F.col("b.score").alias("score"))


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
