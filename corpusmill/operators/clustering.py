"""Soft clusters of vectors, and roll-ups of their members."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def soft_clusters(vectors: DataFrame, dims: int = 10, most: int = 6, share: float = 0.2, seed: int = 42, sample_rows: int = 50_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, probability): a Gaussian mixture over principal components; the number of clusters by the least BIC.

    A row belongs to all clusters with a probability over `share`, else to the likeliest. Under five rows: one cluster. The
    models are fitted on sample_rows rows at most (by hash of the id); all rows are placed.
    """
    import math

    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = vectors.count()
    if n < 5:
        return vectors.select(id_col, F.lit(0).alias("cluster"), F.lit(1.0).alias("probability"))
    points = vectors.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("raw"))
    sample = points.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    pca = PCA(k=dims, inputCol="raw", outputCol="features").fit(sample)
    reduced, best = pca.transform(sample), None
    centred = _one_cluster(reduced, dims, min(n, sample_rows))
    for k in range(2, max(2, min(most, n // 2)) + 1):
        model = GaussianMixture(k=k, seed=seed, maxIter=30, featuresCol="features").fit(reduced)
        free = k - 1 + k * dims + k * dims * (dims + 1) / 2
        bic = free * math.log(min(n, sample_rows)) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = (bic, model)
    if centred <= best[0]:  # one cluster says as much
        return vectors.select(id_col, F.lit(0).alias("cluster"), F.lit(1.0).alias("probability"))
    placed = best[1].transform(pca.transform(points)).select(id_col, F.posexplode(vector_to_array("probability")).alias("cluster", "probability"), F.col("prediction"))
    return placed.where((F.col("probability") > share) | (F.col("cluster") == F.col("prediction"))).select(id_col, "cluster", "probability")


def _one_cluster(reduced: DataFrame, dims: int, n: int) -> float:
    """The BIC of a single Gaussian over the sampled rows, from their covariance (dims x dims)."""
    import math

    import numpy as np
    from pyspark.ml.stat import Summarizer
    from pyspark.ml.functions import vector_to_array

    x = reduced.select(vector_to_array("features").alias("x"))
    size, mean = x.count(), np.array(reduced.select(Summarizer.mean(F.col("features"))).first()[0])
    outer = [F.sum((F.col("x")[i] - float(mean[i])) * (F.col("x")[j] - float(mean[j]))) for i in range(len(mean)) for j in range(i, len(mean))]
    flat = iter(x.agg(*outer).first())
    cov = np.zeros((len(mean), len(mean)))
    for i in range(len(mean)):
        for j in range(i, len(mean)):
            cov[i, j] = cov[j, i] = next(flat) / size
    _, logdet = np.linalg.slogdet(cov + 1e-9 * np.eye(len(mean)))
    likelihood = -0.5 * size * (len(mean) * math.log(2 * math.pi) + logdet + len(mean))
    return (dims + dims * (dims + 1) / 2) * math.log(n) - 2 * likelihood


def roll_up(members: DataFrame, by: str, text_col: str, order: str, source_col: str, joiner: str = "\n", rows: int = 64) -> DataFrame:
    """(by, part, members, sources, text): each cluster's whole texts joined in order, in parts of about `rows` members.

    A cluster may hold a third of all rows: its members are dealt by their number (order modulo the number of parts), so no
    task gathers a cluster, and what reads the parts on (a summary) works on bounded pieces.
    """
    parts = members.groupBy(by).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    dealt = members.join(parts, by).withColumn("part", F.pmod(F.col(order), F.col("_parts")))
    pieces = F.sort_array(F.collect_list(F.struct(order, F.col(text_col).alias("t"))))
    return dealt.groupBy(by, "part").agg(F.count("*").alias("members"), F.sort_array(F.collect_set(source_col)).alias("sources"), F.array_join(F.transform(pieces, lambda p: p["t"]), joiner).alias("text"))


def levels(leaves: DataFrame, assign: Callable[[DataFrame, int], DataFrame], summarize: Callable[[Column], Column], embed: Callable[[Column], Column], most_levels: int = 5) -> DataFrame:
    """All levels of a summary tree: (level, node_id, text, embedding, sources); level 0 are the leaves.

    Each level is clustered (`assign`: rows and level to (node_id, cluster), a row may be in several), the texts of a cluster
    are rolled up and summarised, and the summaries are embedded as the next level's rows, until one node or one cluster is
    left. Level 1 begins with the list of its sources; deeper levels inherit them. Every level is written, not recomputed.
    """
    spark, level = leaves.sparkSession, cut(leaves.select(F.lit(0).alias("level"), "node_id", "text", "embedding", "sources"), "level-0")
    out = [level]
    for n in range(1, most_levels + 1):
        if level.limit(2).count() < 2:
            break
        placed = cut(assign(level.select("node_id", "embedding"), n), "assigned")
        if n > 1 and placed.select("cluster").distinct().limit(2).count() < 2:
            break
        members = placed.select("node_id", "cluster").join(level.select("node_id", "text", F.explode_outer("sources").alias("source")), "node_id")
        texts = placed.select("node_id", "cluster").join(level.select("node_id", "text"), "node_id")
        parts = roll_up(texts.withColumn("source", F.lit(None).cast("string")), "cluster", "text", "node_id", "source", "\n\n")
        summed = parts.select("cluster", "part", summarize(F.col("text")).alias("s"))
        body = summed.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "s"))), lambda p: p["s"]), "\n").alias("s"))  # a summary for each part
        of = members.groupBy("cluster").agg(F.sort_array(F.collect_set("source")).alias("sources"))
        listed = F.concat(F.lit("Sources:\n"), F.array_join(F.transform("sources", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"), "s")
        text = F.when(F.size("sources") > 0, listed).otherwise(F.col("s")) if n == 1 else F.col("s")
        node = F.col("cluster").cast("long") + F.lit(n * 1_000_000_000_000).cast("long")
        level = cut(body.join(of, "cluster").select(F.lit(n).alias("level"), node.alias("node_id"), text.alias("text"), "sources").withColumn("embedding", embed(F.col("text"))).select("level", "node_id", "text", "embedding", "sources"), f"level-{n}")
        out.append(level)
    return reduce(DataFrame.unionByName, out)
