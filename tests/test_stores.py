"""What readers and writers say when something is missing, and inputs made by hand."""

import json

import pytest
from corpusmill import shared, sources
from corpusmill.operators import clustering, evaluation
from pyspark.sql import functions as F


def test_missing_parts_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build"):
        sources.load_graph(spark, f"{tmp_path}/none")
    vectors = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    sources.save_store(vectors, vectors, f"{tmp_path}/store")
    for part in ("chunks", "index", "metadata"):
        sources.clear(spark, f"{tmp_path}/store/{part}")
        with pytest.raises(FileNotFoundError, match=part):
            sources.load_store(spark, f"{tmp_path}/store")


def test_question_sets(spark, tmp_path):
    """Answers are texts and numbers; only answered questions count."""
    (tmp_path / "q.json").write_text(json.dumps({"answered": [{"question": "a", "answers": [1, "x"], "deterministic": True}, {"question": "b", "answers": []}], "unanswered": [{"question": "c"}]}, indent=1))
    assert sorted(map(tuple, sources.read_questions(spark, str(tmp_path / "q.json")).collect())) == [("a", "1\nx", True), ("b", "", False)]
    (tmp_path / "j.json").write_text(json.dumps([{"question": "a", "llm_answer": "1", "reference": "1", "score": 1}, {"question": "b", "score": 0}], indent=1))
    assert sources.read_judgements(spark, str(tmp_path / "j.json")).count() == 2


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.dsl").write_bytes(b"x = 1")
    (tmp_path / "b.dsl").write_bytes(b"x \xff = 1")
    got = {r["file_id"]: r["text"] for r in sources.read_scripts(spark, f"file://{tmp_path}", f"file://{tmp_path}/none", glob="*.dsl").collect()}
    assert got == {"a": "x = 1", "b": None} and sources.read_scripts(spark, f"file://{tmp_path}/none").count() == 0


def test_inverse_mapping_takes_the_last_line(spark, tmp_path):
    (tmp_path / "m.txt").write_text("9,/p\n\nno comma\n10,/q,r\n2,/p\n")
    lines = sources.mapping_lines(spark.read.text(str(tmp_path / "m.txt")))
    assert {tuple(r) for r in sources.inverse_mapping(lines).collect()} == {("/p", "2"), ("/q,r", "10")}


def test_json_types(spark):
    rows = spark.createDataFrame([(1, '{"block_type": "READ"}'), (2, '{"block_type": "nonsense"}')], "id long, json string")
    assert sources.from_json(rows.where("id = 1"), "id", "block_type string").first()["block_type"] == "read"
    with pytest.raises(Exception, match="no such type: nonsense"):
        sources.from_json(rows, "id", "block_type string").collect()


def test_latest_and_first(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k int, o int, v string")
    assert {tuple(r) for r in sources.latest(rows, ["k"], ["o"]).collect()} == {(1, 3, "c"), (2, 1, None)}
    assert {tuple(r) for r in sources.first(rows, ["k"], ["o"]).collect()} == {(1, 1, "a"), (2, 1, None)}


def test_zipped_needs_as_many(spark):
    with pytest.raises(ValueError, match="same number"):
        sources.zipped(spark.range(3), spark.range(4), "id")


def test_numbered_is_the_order(spark):
    x = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 3).alias("w"))
    out = shared.numbered(x, ["w", "v"]).toPandas().sort_values("n")
    want = sorted((i % 3, i * 7 % 1000) for i in range(1000))
    assert list(zip(out["w"], out["v"], strict=True)) == want and out["n"].tolist() == list(range(1, 1001))
    assert shared.numbered(x.limit(0), ["v"]).count() == 0


def test_hot_join(spark):
    """A key with most of the rows, and many others: the same rows as a plain join."""
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id") % 700).alias("k"), "id")
    unique = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1 or k = -1").withColumn("v", F.col("k") * 2)
    want = {tuple(r) for r in rows.join(unique.drop("n"), "k").select("k", "id", "v").collect()}
    assert {tuple(r) for r in shared.hot_join(rows, unique, ["k"], "n", least=100).select("k", "id", "v").collect()} == want
    assert {tuple(r) for r in shared.hot_join(rows, unique, ["k"], "n", how="left_semi", least=100).collect()} == {(k, i) for k, i, _ in want}
    left = {tuple(r) for r in rows.join(unique.drop("n"), "k", "left").select("k", "id", "v").collect()}
    assert {tuple(r) for r in shared.hot_join(rows, unique, ["k"], "n", how="left", least=100).select("k", "id", "v").collect()} == left


def test_joined_in_blocks(spark):
    asked = spark.range(50).select(F.col("id").cast("string").alias("p"))
    rows = spark.range(200).select(F.col("id").cast("string").alias("t"))
    on = F.expr("contains(t, p)")
    want = {tuple(r) for r in rows.join(asked, on).collect()}
    assert {tuple(r) for r in shared.joined_in_blocks(rows, asked, on, most=7).collect()} == want


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_soft_clusters(spark):
    """Two far groups are two clusters, one group is one, and so are a few rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(20 * (i % 2), 1, 12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    two = clustering.soft_clusters(df, dims=2, most=3).toPandas()
    groups = two.groupby("cluster")["vec_id"].agg(lambda x: {i % 2 for i in x})
    assert all(len(g) == 1 for g in groups) and set(two["vec_id"]) == set(range(200))
    one = clustering.soft_clusters(df.where("vec_id % 2 = 0"), dims=2, most=3)
    assert one.select("cluster").distinct().count() == 1 and clustering.soft_clusters(df.limit(4)).select("cluster").distinct().count() == 1


def test_cited_paths(spark):
    said = "See `a/b.dsl`, /a/b.dsl and /9. Tools/x y.dsl; nothing else, Data: /d/e.csv"
    got = spark.createDataFrame([(said,)], "t string").select(evaluation.cited_paths(F.col("t"))).first()[0]
    assert got[0] == "a/b.dsl" and got.count("/a/b.dsl") == 0 and "/d/e.csv" in got and "/9. tools/x y.dsl" in got
