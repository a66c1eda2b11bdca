"""A training corpus from raw documents: toxic ones out, near-duplicates out, personal data generalised, sources mixed, sequences packed.

Each stage takes what its predecessor kept, as Parquet. All but the last return the columns of documents, and any others that
the input has, whatever their names. In all stages repeated rows and null or repeated ids are rows like others, texts are
read whole however long, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, near_dedup, packing, pii, toxicity
from corpusmill.llm.common import cut, table


def _narrow(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage works on, and all others in one, so that no name can clash with the operator's."""
    return docs.select(*own, F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in own)).alias("_rest"))


def _widened(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of docs again; n_chars follows the text."""
    each = {c: F.col(c) if c in own else F.col("_rest")[c].alias(c) for c in docs.columns}
    if "n_chars" in each:
        each["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return df.select(*each.values())


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. The model is fitted on this stage's own input and the labels.

    Null and empty texts have the score of a text without any match and stay; without labels the fixed words alone count.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _widened(toxicity.score_documents(_narrow(docs, "doc_id", "text"), model).where("predicted = 0"), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more), the smallest doc_id.

    Null, empty and blank texts are like nothing and stay. Rows without an id go before none with one; of rows alike in id and
    text all stay where the id isn't null, one where it is.
    """
    return near_dedup.keep_one(docs)


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it give way to the name of their kind. Null texts stay null, all rows stay."""
    found = pii.find_pii(_narrow(docs, "doc_id", "text"))
    return _widened(found.withColumn("text", pii.sanitized(found)), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that the budget ends in is cut to its first words.

    Texts without words (null, too) weigh nothing and are taken by no mix; a null source is a source.
    """
    own = ("doc_id", "text", "source")
    return _widened(mixing.apply_mix(mixing.mix_to_weights(_narrow(docs, *own)), [*own, "_rest"]), docs, *own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens at most; a null text is an empty one."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", generalise_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, MinHash and tokens aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
