"""Dense, sparse and fused retrieval. Every ranked result is ordered by (rounded) score and then by id."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Queries go to the vectors in blocks of this many.
MOST_QUERIES = 10_000


def ranked(scored: DataFrame, score: Column, by: list[str], tie: list[str], k: int | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 within `by`. A filter on the rank lets Spark cut every task's rows to k before the shuffle."""
    order = Window.partitionBy(*by).orderBy(score, *tie)
    out = scored.withColumn(name, F.row_number().over(order).cast("int"))
    return out if k is None else out.where(F.col(name) <= k)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6, with_self: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest by cosine or inner product (highest) or squared distance (lowest).

    queries: (query_id, query). All vectors stay where they are; the queries go to them in blocks of MOST_QUERIES, and each
    Arrow batch of vectors is one matrix product with a block. A batch gives the k best of each query (and their ties).
    """
    n_blocks = max(1, math.ceil(queries.count() / MOST_QUERIES))
    parts = [queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i) for i in range(n_blocks)]
    found = reduce(DataFrame.unionByName, (_scored(vectors, p.select("query_id", "query").collect(), k, metric, id_col, vec_col, digits, with_self) for p in parts))
    return ranked(found, F.asc("score") if metric == "l2" else F.desc("score"), ["query_id"], [id_col], k)


def _scored(vectors: DataFrame, asked: list, k: int, metric: str, id_col: str, vec_col: str, digits: int, with_self: bool) -> DataFrame:
    """(query_id, id, score) of candidates for the k best: a block of queries (bounded) against all vectors, batch by batch."""
    spark = vectors.sparkSession
    names = np.array([r["query_id"] for r in asked], dtype=np.int64)
    shared = spark.sparkContext.broadcast((names, [r["query"] for r in asked]))
    sign = 1 if metric == "l2" else -1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        dims = max([len(x) for x in raw if x is not None], default=0)
        q = _matrix(pa.array(raw, pa.list_(pa.float64())), dims)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dims)
            out: list[list[np.ndarray]] = [[], [], []]
            step = max(1, (1 << 22) // max(1, len(ids)))
            for a in range(0, len(names), step):
                s = np.round(_metric(q[a : a + step], x, metric), digits) + 0.0
                for i, name in enumerate(names[a : a + step].tolist()):
                    here = np.flatnonzero(ids != name) if not with_self else np.arange(len(ids))
                    own = sign * s[i, here]
                    if len(own) > k:
                        at = np.flatnonzero(own <= np.partition(own, k - 1)[k - 1])
                        at = at[np.lexsort((ids[here[at]], own[at]))[:k]]
                    else:
                        at = np.arange(len(own))
                    out[0].append(np.full(len(at), name))
                    out[1].append(ids[here[at]])
                    out[2].append(s[i, here[at]])
            columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["query_id", id_col, "score"])

    own = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col)).where(f"{id_col} is not null and {vec_col} is not null")
    return own.mapInArrow(score, f"query_id long, {id_col} long, score double")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of `dims` columns; shorter rows are filled with 0, what is over is left out."""
    n = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    for i, (a, m) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
        out[i, : min(m, dims)] = flat[a : a + min(m, dims)]
    return out


def _metric(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.stack([((x - row) ** 2).sum(axis=1) for row in q]) if len(q) else np.zeros((0, len(x)))
    s = q @ x.T
    if metric == "cosine":
        with np.errstate(all="ignore"):
            s = s / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :])
        s[~np.isfinite(s)] = 0.0
    return s


def dedup_best(results: DataFrame, key: Column, by: list[str]) -> DataFrame:
    """The best-ranked result of each key, ranked anew."""
    best = results.withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy("rank"))).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank")).cast("int"))


def term_weights(docs: DataFrame, k1: float = 1.2, b: float = 0.75, average: float = 256.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (id, term, weight): term counts saturated by BM25's rule, without inverse frequencies."""
    toks = docs.select(id_col, T.words(F.col(text_col)).alias("w"))
    counts = toks.select(id_col, F.size("w").alias("n"), F.explode("w").alias("term")).groupBy(id_col, "n", "term").agg(F.count("*").alias("c"))
    c = F.col("c")
    return counts.select(id_col, "term", (c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("n") / average))).alias("weight"))


def query_terms(query: str) -> dict[str, int]:
    """The different words of a query with their counts."""
    terms: dict[str, int] = {}
    for w in re.findall(r"\w+", query.lower()):
        terms[w] = terms.get(w, 0) + 1
    return terms


def sparse_search_all(docs: DataFrame, queries: list[str], k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 6, k1: float = 1.2, b: float = 0.75, average: float = 256.0) -> DataFrame:
    """query_no, id, score, rank of every query (a caller's few), in one pass over the texts.

    The terms are counted in the row, so no word is shuffled, and texts that hold none of them aren't taken apart.
    """
    asked = [query_terms(q) for q in queries]
    terms = sorted({t for q in asked for t in q})
    low, words = F.lower(F.col(text_col)), F.col("_words")
    held = docs.where(reduce(lambda x, y: x | y, (F.contains(low, F.lit(t)) for t in terms))).select(id_col, T.words(F.col(text_col)).alias("_words"))
    counted = held.select(id_col, (k1 * (1 - b + b * F.size(words) / average)).alias("_long"), F.array(*(F.size(words) - F.size(F.array_remove(words, t)) for t in terms)).alias("_c"))
    part = lambda t, n: F.col("_c")[terms.index(t)] * (k1 + 1) * n / (F.col("_c")[terms.index(t)] + F.col("_long"))
    scores = F.array(*(F.struct(F.lit(i).alias("query_no"), F.round(reduce(lambda x, y: x + y, (part(t, n) for t, n in q.items())), digits).alias("score")) for i, q in enumerate(asked)))
    found = counted.select(id_col, F.explode(scores).alias("s")).select("s.query_no", id_col, "s.score").where("score > 0")
    return ranked(found, F.desc("score"), ["query_no"], [id_col], k)


def sparse_search(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """id, score, rank by the sum of query weights (counts) and document weights over the query's terms."""
    return sparse_search_all(docs, [query], k, id_col, text_col, digits).drop("query_no")


def search_text(vectors: DataFrame, text: str, embed: Callable[[Column], Column], k: int, **how) -> DataFrame:
    """The nearest vectors of a text: embedded by the same expression (or pandas UDF) as the vectors, then searched."""
    q = vectors.sparkSession.createDataFrame([(-1, text)], "query_id long, text string")
    return dense_search(vectors, q.select("query_id", embed(F.col("text")).alias("query")), k, **how)


def store_rows(found: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Search results with the rows that they stand for; what the store has no row for stays, without one."""
    return found.join(chunks, key, "left")


def fuse(streams: list[DataFrame], k: int, constant: int = 60, key: str = "doc_id", digits: int = 8) -> DataFrame:
    """Reciprocal rank fusion of streams (key, rank): the sum of 1 / (constant + rank)."""
    every = streams[0].select(key, "rank")
    for s in streams[1:]:
        every = every.unionByName(s.select(key, "rank"))
    scored = every.groupBy(key).agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), digits).alias("score"))
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("int"))


def keyword_boost(results: DataFrame, keys: list[str], text_col: str = "text", source_col: str | None = None, source_pattern: str | None = None, step: float = 0.1, off_source: float = 0.85) -> DataFrame:
    """Scores times (1 + step * share of keys met), 1 at most, if any is met; results off the wanted sources count less."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    hits = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keys), F.lit(0))
    boosted = F.when(hits > 0, F.least(F.lit(1.0), F.col("score") * (1 + step * hits / len(keys)))).otherwise(F.col("score"))
    if source_pattern is not None:
        boosted = F.when(F.coalesce(F.col(source_col).rlike(f"(?iu){source_pattern}"), F.lit(False)), boosted).otherwise(boosted * off_source)
    return results.withColumn("score", boosted)


def drop_off(results: DataFrame, least: float = 0.15, share: float = 0.4, by: list[str] | None = None) -> DataFrame:
    """Scores of `least` or more and of `share` of the best or more (per query, if `by` is given)."""
    best = F.max("score").over(Window.partitionBy(*(by or [F.lit(1)])))
    return results.withColumn("_best", best).where((F.col("score") >= least) & (F.col("score") >= share * F.col("_best"))).drop("_best")


def rerank(results: DataFrame, scorer: Callable[[DataFrame], Column], by: list[str], tie: list[str], digits: int = 6) -> DataFrame:
    """A new score from any expression (or pandas UDF) as a sigmoid of its logit; the old one stays as original_score."""
    logit = scorer(results)
    out = results.withColumn("original_score", F.col("score")).withColumn("score", F.round(1 / (1 + F.exp(-logit)), digits)).drop("rank")
    return ranked(out, F.desc("score"), by, tie)
