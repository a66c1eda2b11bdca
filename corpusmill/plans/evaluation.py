"""Grading, statistics, histories, stores, clusters and the streaming twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import sources, streaming
from ..functions import text as T
from ..operators import evaluation as E
from ..operators.clustering import levels, roll_up, soft_clusters
from ..registry import query
from ..shared import joined_in_blocks, scratch
from .inputs import DUCK, scripts, table


_NORM = "regexp_replace(lower(regexp_replace({x}, '\\s+', '', 'g')), '[^\\p{{L}}\\p{{N}}_/.\\-]', '', 'g')"


@query("hybrid_grade", f"""WITH p AS (SELECT b.item_id, b.item_id % 4 <> 3 AS deterministic, {_NORM.format(x="d.text || CASE WHEN b.item_id % 3 = 0 THEN chr(10) || replace(b.text, ' ', ' , ') ELSE '' END")} AS r, list_filter(list_transform(string_split(b.text, chr(10)), lambda x: {_NORM.format(x='x')}), lambda x: x <> '') AS ls FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, CASE WHEN deterministic THEN CAST(len(list_filter(ls, lambda x: contains(r, x))) AS INTEGER) END AS matched, CASE WHEN NOT deterministic THEN round(0.6 * exp(1.0) / (exp(1.0) + 2) + 0.4 / (1 + exp(-(item_id % 11 - 5.0))), 6) WHEN len(ls) > 0 AND len(list_filter(ls, lambda x: contains(r, x))) = len(ls) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN deterministic THEN 'containment' ELSE 'model' END AS method FROM p""")
def hybrid_grade(spark, d):
    """Each question's answer: by containment of its reference where that is fixed, else by the cross-encoders' logits."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference"), (F.col("item_id") % 4 != 3).alias("deterministic"))
    a = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    said = F.concat("text", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("\n"), F.replace("reference", F.lit(" "), F.lit(" , ")))).otherwise(F.lit("")))
    model = F.round(E.dual_grade(F.lit(1.0), F.lit(0.0), F.lit(0.0), (F.col("item_id") % 11) - 5.0), 6)
    return E.hybrid_grade(b.join(a, "item_id").withColumn("response", said), model).select("item_id", "matched", "score", "method")


@query("mean_grades", "WITH g AS (SELECT CASE doc_id % 5 WHEN 0 THEN NULL ELSE (doc_id % 3) / 2.0::DOUBLE END AS score FROM documents) SELECT round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score > 0) AS correct, count(*) FILTER (WHERE score IS NULL) AS issues, count(*) AS n FROM g")
def mean_grades(spark, d):
    g = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 3) / 2.0).alias("score"))
    return E.mean_grade(g).withColumn("mean_score", F.round("mean_score", 6))


@query("reference_coverage", "SELECT b.item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def reference_coverage(spark, d):
    """In how many texts each reference stands whole; the references go to the texts in blocks."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference"))
    hits = joined_in_blocks(table(spark, d, "documents").select("text"), b, F.expr("contains(text, reference)"), 1000, lambda x: x.select("item_id"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"))


_LOGITS = "(doc_id % 7) - 3.0"


@query("dual_grade", """WITH l AS (SELECT doc_id, (doc_id % 7) - 3.0::DOUBLE AS e, (doc_id % 5) - 2.0::DOUBLE AS n, (doc_id % 3) - 1.0::DOUBLE AS c, (doc_id % 11) - 5.0::DOUBLE AS r FROM documents), p AS (SELECT *, exp(e) / (exp(e) + exp(n) + exp(c)) AS pe, exp(c) / (exp(e) + exp(n) + exp(c)) AS pc FROM l)
SELECT doc_id, round(CASE WHEN pc > 0.5 THEN 0.0 ELSE 0.6 * pe + 0.4 / (1 + exp(-r)) END, 6) AS score FROM p""")
def dual_grade(spark, d):
    x = lambda m, s: (F.col("doc_id") % m) - float(s)
    return table(spark, d, "documents").select("doc_id", F.round(E.dual_grade(x(7, 3), x(5, 2), x(3, 1), x(11, 5)), 6).alias("score"))


@query("judge_json_parse", """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"score": ' || CAST(doc_id % 6 AS VARCHAR) || '}' WHEN 1 THEN 'Sure: {"score": 4, "reasoning": "ok"} done' WHEN 2 THEN 'no json' ELSE '{"score": "x"}' END AS reply FROM documents),
s AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(reply, '"score": (\\d+)', 1), '') AS INT) AS raw FROM r) SELECT doc_id, CASE WHEN raw BETWEEN 1 AND 5 THEN (raw - 1) / 4.0::DOUBLE END AS score FROM s""")
def judge_json_parse(spark, d):
    m = F.col("doc_id") % 4
    reply = F.when(m == 0, F.concat(F.lit('{"score": '), (F.col("doc_id") % 6).cast("string"), F.lit("}"))).when(m == 1, 'Sure: {"score": 4, "reasoning": "ok"} done').when(m == 2, "no json").otherwise('{"score": "x"}')
    return table(spark, d, "documents").select("doc_id", E.judge_score(reply, 1, 5).alias("score"))


@query("judge_binary", """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"score": 1}' WHEN 1 THEN 'ok {"score": 0, "reasoning": "no"}' WHEN 2 THEN '{"score": 2}' WHEN 3 THEN 'none' ELSE '{"score": null}' END AS reply FROM documents), s AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(reply, '"score": (\\d+)', 1), '') AS INT) AS raw FROM r)
SELECT round(avg(raw) FILTER (WHERE raw IN (0, 1)), 6) AS mean_score, count(*) FILTER (WHERE raw = 1) AS correct, count(*) FILTER (WHERE raw IS NULL OR raw NOT IN (0, 1)) AS issues, count(*) AS n FROM s""")
def judge_binary(spark, d):
    """Replies that must say 0 or 1; others are issues and don't count in the mean."""
    m = F.col("doc_id") % 5
    reply = F.when(m == 0, '{"score": 1}').when(m == 1, 'ok {"score": 0, "reasoning": "no"}').when(m == 2, '{"score": 2}').when(m == 3, "none").otherwise('{"score": null}')
    return E.mean_grade(table(spark, d, "documents").select(E.judge_score(reply, 0, 1).alias("score"))).withColumn("mean_score", F.round("mean_score", 6))


@query("judge_agreement", "WITH j AS (SELECT 'q' || CAST(doc_id AS VARCHAR) AS question, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 2 END AS score FROM documents), r AS (SELECT 'q' || CAST(doc_id AS VARCHAR) AS question, toxic AS want FROM labels) SELECT CAST(sum((score = want)::INT) AS BIGINT) AS agree, count(*) AS n, round(avg((score = want)::INT), 6) AS agreement FROM j JOIN r USING (question) WHERE score IS NOT NULL")
def judge_agreement(spark, d):
    """A judge's verdicts against a calibration set read from JSON, by question."""
    at, name = scratch(spark, "calibration"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question")
    table(spark, d, "labels").select(name, F.lit("x").alias("llm_answer"), F.lit("y").alias("reference"), F.col("toxic").alias("score")).write.json(at)
    judged = table(spark, d, "documents").select(name, F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 2).alias("score"))
    return E.judge_against(judged, sources.read_judgements(spark, at, one_list=False).select("question", "score")).withColumn("agreement", F.round("agreement", 6))


@query("path_validation", rf"""WITH scripts AS ({DUCK}), c AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN ltrim(lower(path), '/') WHEN 1 THEN lower('y' || path) WHEN 2 THEN '/none/' || CAST(doc_id AS VARCHAR) || '.dsl' ELSE '/data/x' || CAST(doc_id AS VARCHAR) || '.csv' END AS cited FROM scripts),
k AS (SELECT path, ltrim(regexp_replace(lower(path), '\.(dsl|lib)$', ''), '/') AS key FROM scripts), a AS (SELECT *, ltrim(regexp_replace(cited, '\.(dsl|lib)$', ''), '/') AS ckey, ends_with(cited, '.csv') AS ignored FROM c),
m AS (SELECT a.*, (SELECT max(path) FROM k WHERE k.key = a.ckey) AS exact, (SELECT count(*) FROM k WHERE ends_with(k.key, a.ckey) OR ends_with(a.ckey, k.key)) AS n, (SELECT min(path) FROM k WHERE ends_with(k.key, a.ckey) OR ends_with(a.ckey, k.key)) AS near FROM a)
SELECT id, cited, CASE WHEN ignored THEN 'ignored' WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'suffix' ELSE 'invalid' END AS status, CASE WHEN ignored THEN NULL WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN near END AS path FROM m""")
def path_validation(spark, d):
    """Paths cited in answers: without the first slash, with something before, made up, or of a data file."""
    s, m = scripts(spark, d), F.col("doc_id") % 4
    number = F.col("doc_id").cast("string")
    said = F.when(m == 0, F.concat(F.lit("see `"), F.expr("substring(path, 2)"), F.lit("`."))).when(m == 1, F.concat(F.lit("in `y"), "path", F.lit("` only"))).when(m == 2, F.concat(F.lit('at "/none/'), number, F.lit('.dsl" and /none/'), number, F.lit(".dsl"))).otherwise(F.concat(F.lit("from /data/x"), number, F.lit(".csv")))
    cited = s.select(F.col("doc_id").alias("id"), F.explode(E.cited_paths(said)).alias("cited"))
    return E.validate_paths(cited, s.select("path"), ignore_data=True)


@query("tool_stats", "SELECT event_type AS tool, count(*) AS calls, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean_seconds, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def tool_stats(spark, d):
    return E.tool_stats(table(spark, d, "events")).select("tool", "calls", F.round("seconds", 4).alias("seconds"), F.round("mean_seconds", 6).alias("mean_seconds"), F.round("percent", 6).alias("percent"))


@query("rate_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2")
def rate_windows(spark, d):
    out = streaming.rate_windows(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "calls", F.round("seconds", 4).alias("seconds"))


@query("stream_rate_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2")
def stream_rate_windows(spark, d):
    """The same as a stream that takes what there is: results are complete when it ends."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    name = f"rates_{uuid.uuid4().hex}"
    out = streaming.rate_windows(events).writeStream.outputMode("complete").format("memory").queryName(name)
    out.option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "calls", F.round("seconds", 4).alias("seconds"))


@query("history_compact", "WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n > 5 THEN n - 4 ELSE 0 END AS omitted FROM h WHERE n <= 5 OR i = 1 OR i > n - 3")
def history_compact(spark, d):
    return E.compact_history(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("question_answer_pairs", "SELECT conv_id, turn, text AS question, nxt AS answer FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations) WHERE role = 'user' AND r2 = 'assistant'")
def question_answer_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return x.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("recent_tools", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, count(*) AS uses FROM r WHERE n <= 6 GROUP BY ALL HAVING count(*) >= 2")
def recent_tools(spark, d):
    """Tools used twice or more among each user's last six actions."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 6")
    return last.groupBy("user_id", "event_type").agg(F.count("*").alias("uses")).where("uses >= 2")


@query("evidence_lookup", "WITH e AS (SELECT 'ev_' || left(sha256(text), 16) AS evidence_id, min(doc_id) AS doc_id FROM documents GROUP BY 1), a AS (SELECT item_id AS id, 'ev_' || left(sha256(coalesce(d.text, b.text)), 16) AS evidence_id FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id AND b.item_id % 2 = 0) SELECT a.id, a.evidence_id, e.doc_id IS NOT NULL AS found, e.doc_id FROM a LEFT JOIN e USING (evidence_id)")
def evidence_lookup(spark, d):
    """Ids made of contents, looked up among the first documents of each content; some are of nothing that is stored."""
    docs = table(spark, d, "documents")
    store = docs.select(T.evidence_id(F.col("text")).alias("evidence_id"), "doc_id").groupBy("evidence_id").agg(F.min("doc_id").alias("doc_id"))
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("own"))
    asked = b.join(docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), "text"), "item_id", "left")
    return E.evidence_of(asked.select(F.col("item_id").alias("id"), T.evidence_id(F.coalesce("text", "own")).alias("evidence_id")), store).select("id", "evidence_id", "found", "doc_id")


@query("parse_facts", """WITH r AS (SELECT doc_id AS id, doc_id % 3 AS m, lang FROM documents) SELECT id, CAST(i AS INTEGER) AS fact_no, CASE i WHEN 1 THEN 'uses ' || lang ELSE 'second' END AS fact, CASE i WHEN 1 THEN [CAST(id % 5 AS INTEGER), 7] ELSE CAST([] AS INTEGER[]) END AS evidence FROM r, range(1, 3) x(i) WHERE m < 2""")
def parse_facts(spark, d):
    """Facts from recorded replies: a list by itself, in a fence after some prose, or none."""
    m = F.col("doc_id") % 3
    body = F.concat(F.lit('[{"response": " uses '), "lang", F.lit('", "evidence_ids": ['), (F.col("doc_id") % 5).cast("string"), F.lit(', 7, "x"]}, {"response": "second"}, {"response": " "}]'))
    reply = F.when(m == 0, body).when(m == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise("[no list")
    return E.parse_facts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), reply.alias("reply")))


@query("token_counters", "SELECT role, count(*) AS messages, sum(length(text) // 3)::BIGINT AS tokens FROM conversations GROUP BY role")
def token_counters(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("messages"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("soft_cluster")
def soft_cluster(spark, d):
    return soft_clusters(table(spark, d, "embeddings"), most=4)


@query("cluster_rollup", "WITH m AS (SELECT e.label, d.*, count(*) OVER (PARTITION BY e.label) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) SELECT label, CAST(doc_id % CAST(ceil(n / 64) AS BIGINT) AS BIGINT) AS part, count(*) AS members, list(DISTINCT source ORDER BY source) AS sources, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM m GROUP BY 1, 2")
def cluster_rollup(spark, d):
    """Clusters' whole texts in bounded parts."""
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label").join(table(spark, d, "documents"), "doc_id")
    return roll_up(x, "label", "text", "doc_id", "source")


@query(
    "summary_levels",
    "WITH l0 AS (SELECT 0 AS level, doc_id AS node_id, [source] AS sources FROM documents), g1 AS (SELECT 1 AS level, 1000000000000 + node_id % 9 AS node_id, list_distinct(flatten(list(sources))) AS sources FROM l0 GROUP BY node_id % 9), "
    "g2 AS (SELECT 2 AS level, 2000000000000 + node_id % 3 AS node_id, list_distinct(flatten(list(sources))) AS sources FROM g1 GROUP BY node_id % 3) SELECT level, node_id, len(sources) AS sources FROM (SELECT * FROM l0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)",
)
def summary_levels(spark, d):
    """A tree of summaries over stated clusters (9, then 3; the third level would be one and ends it), with a cut text as the summary."""
    leaves = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text", F.array(F.length("text").cast("double")).alias("embedding"), F.array("source").alias("sources"))
    clusters = {1: 9, 2: 3}
    tree = levels(leaves, lambda rows, n: rows.select("node_id", (F.col("node_id") % clusters.get(n, 1)).alias("cluster")), lambda t: F.substring(t, 1, 40), lambda t: F.array(F.length(t).cast("double")))
    return tree.select("level", "node_id", F.size("sources").cast("long").alias("sources"))


@query("results_by_domain", "SELECT lang, count(*) AS files, count(DISTINCT source) AS folders FROM documents GROUP BY lang")
def results_by_domain(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.countDistinct("source").alias("folders"))


@query("capped_text", "SELECT doc_id, CASE WHEN length(text) > 12000 THEN left(text, 12000) || '...' ELSE text END AS shown FROM documents")
def capped_text(spark, d):
    """A tool's result is cut to 12,000 characters: the limit is the feature."""
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 12000, F.concat(F.substring("text", 1, 12000), F.lit("..."))).otherwise(F.col("text")).alias("shown"))
