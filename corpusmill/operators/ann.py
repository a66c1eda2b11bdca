"""Approximate search by k-means cells: rows are laid out by cell, a query reads its nearest cells only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shared import small
from .retrieval import dense_search, ranked


def ivf_index(vectors: DataFrame, cells: int = 100, seed: int = 42, sample_rows: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with their `cell`, centres). Centres are fitted on `sample_rows` rows at most (by hash of the id); every row is placed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    points = sample.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=20).fit(points)
    placed = model.transform(vectors.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))).withColumnRenamed("prediction", "cell").drop("features")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # `cells` of them
    return placed, vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>")


def ivf_search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, probes: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank by cosine within the `probes` nearest cells of each query."""
    placed, centres = index
    near = dense_search(centres.withColumn("cell", F.col("cell").cast("long")), queries, probes, "l2", "cell", "centre", with_self=True).select("query_id", F.col("cell").cast("int").alias("cell"))
    # few cells, many queries: a query goes to its cells, small sets of queries by broadcast and others by a shuffle on the cell
    asked = small(near.join(queries, "query_id"))
    pairs = placed.join(asked, "cell").where(F.col(id_col) != F.col("query_id"))
    scored = pairs.select("query_id", id_col, F.round(V.cosine(F.col(vec_col), F.col("query")), digits).alias("score"))
    return ranked(scored, F.desc("score"), ["query_id"], [id_col], k)
