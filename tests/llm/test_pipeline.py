"""The pipeline's stages: what each does to its own input."""

import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as P
    from corpusmill.llm import near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs.withColumn("size", F.lit("extra")).withColumn("email", F.lit("extra")) if name != "packing" else docs, SF)
        if name != "packing":
            assert out.columns == [*columns, "size", "email"] and out.where("size != 'extra' or email != 'extra'").count() == 0
            out = out.select(*columns)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
    whole = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").toPandas()["doc_id"]
    kept = set(seen["toxicity"]["doc_id"])
    assert len(kept & set(toxic)) >= 0.97 * len(toxic) and len(kept) < len(whole)
    again = near_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/near_dedup"))
    assert again.where("not kept").count() == 0
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9]+\.[A-Za-z0-9]", t) for t in seen["pii"]["text"])
    assert len(seen["pii"]) == len(seen["near_dedup"]) and (seen["mixing"]["n_chars"] == seen["mixing"]["text"].str.len()).all()
    assert seen["packing"].groupby("sequence_id")["length"].sum().max() <= 1024


def test_run(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns with the operators' names, through all stages."""
    import corpus_pipeline as P

    long = "many words in a long text by a@b.co " * 3000
    rows = [(1, "a b c d e f g", "en", "s", 13), (2, None, "en", None, None), (None, "", None, "s", 0), (None, "a b c d e f g", "en", "s", 13), (3, long, "en", "t", len(long)), (3, long, "en", "t", len(long)), (4, long + "end", "en", "t", 9), (5, "you stupid idiot and scum", "en", "s", 25), (5, "fine words of five or more", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(c) for c in ("toxic", "terms", "row", "key", "size", "target", "taken", "score", "raw", "bands", "set_key", "email", "h", "length", "piece", "part")}
    docs = docs.withColumns(extra)
    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert all(r[c] == c for r in kept[name] for c in extra)
    ids = lambda n: sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept[n])
    assert (5, "you stupi") not in ids("toxicity") and len(kept["toxicity"]) == len(rows) - 1
    assert ids("near_dedup") == [(0, ""), (1, "a b c d e"), (2, ""), (3, "many word"), (3, "many word"), (5, "fine word")]
    assert len(kept["pii"]) == 6 and not any("a@b.co" in (r["text"] or "") for r in kept["pii"]) and any(r["text"] is None for r in kept["pii"])
    assert all(r["text"] for r in kept["mixing"]) and {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["mixing"]}
    none = spark.read.parquet(f"{tmp_path}/toxicity").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
