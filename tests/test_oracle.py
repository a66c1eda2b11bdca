"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from corpusmill import plans, registry

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in columns) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_ann_recall(spark, sf):
    """At least 0.9 of the true neighbours of every id divisible by 100, by brute force."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.array(e["embedding"].tolist(), dtype=float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    ids = e["vec_id"].to_numpy()
    got = registry.QUERIES["ann_kmeans"](spark, sf).toPandas().groupby("query_id")["vec_id"].agg(set)
    assert set(got.index) == {i for i in ids.tolist() if i % 100 == 0}
    recall = []
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.where(ids == ids[i], -9, np.round(x @ x[i], 6))
        recall.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -score))[:5]].tolist())) / 5)
    assert np.mean(recall) >= 0.9
