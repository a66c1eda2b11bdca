"""Vectors whose rounded components are hard to get right."""

import math

import duckdb
from corpusmill import plans, registry
from corpusmill.functions import vectors as V

plans.load()


def with_norm(norm: int, first: int) -> list[float]:
    """Whole numbers, `first` among them, whose squares add up to that of `norm`."""
    out, rest = [float(first)], norm**2 - first**2
    while rest:
        out.append(float(math.isqrt(rest)))
        rest -= math.isqrt(rest) ** 2
    return out


ODD = [
    [0.6, -4e-7, 0.8, 4e-7],  # -0.0 and 0.0
    with_norm(2_000_000, 1026965),  # 0.5134825, which is just below the half once it is scaled
    with_norm(2_000_000, 521297),
    [-x for x in with_norm(2_000_000, 1026965)],
    [0.0, -0.0, 0.0],
    [3e38, 1.0],
    [float("nan"), 1.0],
    [float("inf"), 1.0, float("-inf")],
    [],
    None,
]


def test_normalize_vectors_to_the_bit(spark, tmp_path):
    """As SQL gives it, signs of zeros, halves and 0 / 0 included."""
    spark.createDataFrame(list(enumerate(ODD)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, registry.QUERIES["normalize_vectors"](spark, str(tmp_path)).select("vec_id", "norm_before", "unit").collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(c.execute(registry.ORACLE_SQL["normalize_vectors"]).fetchall())
    assert list(map(repr, got)) == list(map(repr, want))
    assert math.copysign(1, got[0][2][1]) == -1 and got[1][2][0] == 0.513482


def test_normalized(spark):
    """By itself it keeps a vector without length."""
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    assert [r["u"] for r in rows.select(V.normalized(rows["v"]).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
