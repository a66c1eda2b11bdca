"""Grading answers, checking cited paths, and statistics of tool use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def containment_grade(response: Column, lines: Column) -> tuple[Column, Column]:
    """(matched lines, score): 1 only if every line of the reference is in the response. Both sides normalised beforehand, see `reference_lines`."""
    met = F.size(F.filter(lines, lambda x: F.contains(response, x)))
    return met, F.when((F.size(lines) > 0) & (met == F.size(lines)), 1.0).otherwise(0.0)


def reference_lines(reference: Column) -> Column:
    """The non-blank lines of a reference, normalised."""
    return F.filter(F.transform(T.lines(reference), T.normalized_answer), lambda x: x != "")


def hybrid_grade(answers: DataFrame, other: Column) -> DataFrame:
    """answers (id, response, reference, deterministic) with matched, score and method.

    Deterministic answers must hold every line of their reference; others get `other`, a score of any grader. Each text is
    normalised once, as a column, before the lines are compared.
    """
    ready = answers.withColumn("_r", F.when(F.col("deterministic"), T.normalized_answer(F.col("response")))).withColumn("_l", F.when(F.col("deterministic"), reference_lines(F.col("reference"))))
    met, score = containment_grade(F.col("_r"), F.col("_l"))
    graded = ready.withColumn("matched", F.when(F.col("deterministic"), met)).withColumn("score", F.when(F.col("deterministic"), score).otherwise(other))
    return graded.withColumn("method", F.when(F.col("deterministic"), "containment").otherwise("model")).drop("_r", "_l")


def mean_grade(grades: DataFrame, score: str = "score") -> DataFrame:
    """(mean_score, correct, issues, n): the mean over rows that have a grade (null without any), those over 0, and those without one."""
    x = F.col(score)
    return grades.agg(F.avg(x).alias("mean_score"), F.count_if(x > 0).alias("correct"), F.count_if(x.isNull()).alias("issues"), F.count("*").alias("n"))


def judge_against(judged: DataFrame, reference: DataFrame) -> DataFrame:
    """(agree, n, agreement) of a judge's scores with a calibration set, by question; questions without a verdict don't count."""
    x = judged.where("score is not null").join(reference.withColumnRenamed("score", "want"), "question")
    same = (F.col("score") == F.col("want")).cast("long")
    return x.agg(F.sum(same).alias("agree"), F.count("*").alias("n"), F.avg(same).alias("agreement"))


def dual_grade(entail: Column, neutral: Column, contradict: Column, relevance: Column) -> Column:
    """From logits: 0 if a contradiction is likelier than not, else 0.6 entailment + 0.4 relevance."""
    top = F.greatest(entail, neutral, contradict)
    e, n, c = (F.exp(x - top) for x in (entail, neutral, contradict))
    total = e + n + c
    return F.when(c / total > 0.5, 0.0).otherwise(0.6 * e / total + 0.4 / (1 + F.exp(-relevance)))


def judge_score(reply: Column, low: int, high: int) -> Column:
    """The score in the first JSON object of a reply, scaled to 0..1; null if there is none, or it is out of range."""
    raw = F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*?\})", 1), "$.score").try_cast("int")
    return F.when(raw.between(low, high), (raw - low) / float(high - low))


#: Four ways to cite a path: in backticks, with a known extension, from a numbered folder, a numbered file.
_EXTENSIONS = "dsl|lib|csv|ion|xlsx"
_PATHS = (
    r"`([^`\n]+)`",
    rf"(?i)(?:^|[^\w`/])(/?[^,\n`\s]*?/[^\n,`]*?\.(?:{_EXTENSIONS}))\b",
    r"(?:^|[^\w`/])(/?\d[^,\n`:;]*?/[^,\n`\s]+)",
    r"(?i)(?:^|[^\w/])(/?\d[^,\n`/]*?\.(?:dsl|lib))\b",
)


def cited_paths(text: Column) -> Column:
    """Paths cited in a text by any of four patterns, cleaned, each once (whatever its case and first slash) in the order of the patterns."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _PATHS)))
    clean = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r"^[^/]*:[^/]*/", "/"), r"^[\s'\"`(\[]+|[\s'\"`)\],.;:}]+$", ""))
    shaped = F.filter(clean, lambda x: x.rlike(rf"/.*/|/\d|^\d.*/|\.(?:{_EXTENSIONS})$"))
    bare = lambda x: F.ltrim(x, F.lit("/"))
    return F.filter(shaped, lambda x, i: ~F.exists(F.slice(shaped, F.lit(1), i), lambda y: bare(y) == bare(x)))


#: Extensions of data files, whose citations aren't checked.
DATA_EXTENSIONS = ("ion", "csv")


def is_data_path(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*DATA_EXTENSIONS)


def validate_paths(cited: DataFrame, known: DataFrame, ignore_data: bool = False) -> DataFrame:
    """(id, cited, status, path): ignored (a data file, if asked for), exact, else suffix if one known path alone ends with it (or it with that), else invalid.

    Paths are compared without their case, first slash and the scripts' extensions. known: (path).
    """
    key = lambda c: F.ltrim(F.regexp_replace(F.lower(c), r"\.(dsl|lib)$", ""), F.lit("/"))
    k = known.select(key(F.col("path")).alias("key"), "path").groupBy("key").agg(F.max("path").alias("path"))
    skip = is_data_path(F.col("cited")) if ignore_data else F.lit(False)
    asked = cited.select("id", "cited").withColumn("c", key(F.col("cited")))
    checked = asked.where(~skip)
    exact = checked.join(k, checked["c"] == k["key"], "left").drop("key")
    rest = exact.where("path is null").select("id", "cited", "c")
    near = rest.withColumn("last", T.base_name(F.col("c"))).join(k.withColumn("last", T.base_name(F.col("key"))), "last").where(F.endswith("key", "c") | F.endswith("c", "key"))
    one = near.groupBy("id", "cited").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("id", "cited", "path")
    suffix = rest.select("id", "cited").join(one, ["id", "cited"], "left")
    status = F.when(F.col("path").isNotNull(), "suffix").otherwise("invalid")
    out = exact.where("path is not null").select("id", "cited", F.lit("exact").alias("status"), "path").unionByName(suffix.select("id", "cited", status.alias("status"), "path"))
    return out.unionByName(asked.where(skip).select("id", "cited", F.lit("ignored").alias("status"), F.lit(None).cast("string").alias("path")))


def tool_stats(events: DataFrame, tool: str = "event_type", elapsed: str = "value") -> DataFrame:
    """Calls, total and mean time of each tool, and its share of all time in percent (0 if there is none)."""
    each = events.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), F.sum(elapsed).alias("seconds"), F.avg(elapsed).alias("mean_seconds"))
    total = F.sum("seconds").over(Window.partitionBy(F.lit(1)))
    return each.withColumn("percent", F.when(total > 0, 100 * F.col("seconds") / total).otherwise(0.0))


def compact_history(log: DataFrame, by: list[str], order: str, most: int = 5) -> DataFrame:
    """The first and the last three steps of each log with more than `most`, all of the others; `omitted` counts what is left out."""
    w = Window.partitionBy(*by)
    x = log.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return x.where((F.col("_n") <= most) | (F.col("_i") == 1) | (F.col("_i") > F.col("_n") - 3)).withColumn("omitted", F.when(F.col("_n") > most, F.col("_n") - 4).otherwise(0)).drop("_i", "_n")


def parse_facts(replies: DataFrame) -> DataFrame:
    """(id, fact_no, fact, evidence): facts of a reply's first JSON list, also inside prose or a code fence; replies without one have none.

    replies: (id, reply). Evidence numbers that aren't whole numbers are left out, blank facts too.
    """
    body = F.regexp_extract("reply", r"(?s)(\[\s*\{.*\}\s*\])", 1)
    read = F.from_json(body, "array<struct<response: string, evidence_ids: array<string>>>")
    x = replies.select("id", F.posexplode(F.filter(read, lambda f: F.trim(f["response"]) != "")).alias("i", "f"))
    ids = F.array_compact(F.transform("f.evidence_ids", lambda e: e.try_cast("int")))
    return x.select("id", (F.col("i") + 1).alias("fact_no"), F.trim("f.response").alias("fact"), F.coalesce(ids, F.array().cast("array<int>")).alias("evidence"))


def evidence_of(asked: DataFrame, store: DataFrame) -> DataFrame:
    """(id, evidence_id, found, doc_id): what each id stands for; ids that the store lacks stay, as not found."""
    return asked.join(store.withColumn("found", F.lit(True)), "evidence_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
