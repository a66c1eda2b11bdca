"""Embedding, composed retrieval, indexes of definitions, and what agents keep."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..operators import embedding as M
from ..operators import graph as G
from ..operators import grep
from ..operators import retrieval as R
from ..operators import scripts as S
from ..registry import query
from ..shared import numbered
from .graph import EDGES, edges
from .inputs import BLOCKS, LINES, SCRIPT_LINES, case_sql, scripts, table
from .search import _DENSE_SQL, _FUSED_SQL, QUERY, _dense, _sparse_sql

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("embedding_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, 50) ELSE 'Type: ' || lang || chr(10) || 'Context: ' || coalesce(source, 'none') || chr(10) || 'Code:' || chr(10) || text END AS prepared FROM documents")
def embedding_text(spark, d):
    summary = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 50))
    return table(spark, d, "documents").select("doc_id", M.embedding_text(summary, F.col("text"), F.col("lang"), F.col("source")).alias("prepared"))


@query("hashing_embedder")
def hashing_embedder(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(M.hashing_vector(F.col("text")), lambda x: F.round(x, 6)).alias("vector"))


def _letters():
    import numpy as np

    return lambda texts: np.array([[t.count(c) for c in "etaoinsr"] for t in texts], dtype=np.float32)


@query("model_embedder", "SELECT doc_id, [" + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in "etaoinsr") + "] AS vector FROM documents")
def model_embedder(spark, d):
    """The slot for a model, filled with letter counts."""
    v = M.model_udf(_letters)(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.transform(v, lambda x: x.cast("double")).alias("vector"))


@query("cosine_grade", "SELECT round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS mean_score, count(*) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_grade(spark, d):
    """Answer and reference vectors, here each row and its successor: the mean cosine."""
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").agg(F.round(F.avg(V.cosine(F.col("x"), F.col("y"))), 6).alias("mean_score"), F.count("*").alias("n"))


@query("results_from_question", "SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark QUALIFY n >= 5")
def results_from_question(spark, d):
    """The fifth question and all after it."""
    return numbered(table(spark, d, "benchmark").select("item_id"), ["item_id"]).where("n >= 5")


@query("definition_index", f"WITH RECURSIVE {BLOCKS}, x AS (SELECT DISTINCT doc_id, regexp_replace(unnest(definitions), '\\d+$', '') AS name FROM blocks) SELECT name, count(*) AS scripts, min(doc_id) AS first_script FROM x GROUP BY name")
def definition_index(spark, d):
    """Which scripts define a name (numbers at its end left off)."""
    blocks = S.parse_scripts(scripts(spark, d)).select("doc_id", F.explode("definitions").alias("name"))
    return blocks.select("doc_id", F.regexp_replace("name", r"\d+$", "").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("scripts"), F.min("doc_id").alias("first_script"))


@query(
    "dependency_index",
    f"WITH RECURSIVE {BLOCKS}, x AS (SELECT 'dependent' AS kind, doc_id, regexp_replace(unnest(dependencies), '\\d+$', '') AS name FROM blocks UNION SELECT 'type', doc_id, block_type FROM blocks) SELECT kind, name, count(*) AS scripts, min(doc_id) AS first_script FROM x GROUP BY kind, name",
)
def dependency_index(spark, d):
    """Which scripts need a name, and which have a type of block."""
    b = S.parse_scripts(scripts(spark, d))
    needs = b.select(F.lit("dependent").alias("kind"), "doc_id", F.explode("dependencies").alias("name")).withColumn("name", F.regexp_replace("name", r"\d+$", ""))
    types = b.select(F.lit("type").alias("kind"), "doc_id", F.col("block_type").alias("name"))
    return needs.unionByName(types).distinct().groupBy("kind", "name").agg(F.count("*").alias("scripts"), F.min("doc_id").alias("first_script"))


@query("child_ordinals", "SELECT doc_id, source || '.' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS ordinal FROM documents")
def child_ordinals(spark, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(".", "source", n.cast("string")).alias("ordinal"))


@query("dominant_type", f"WITH {SCRIPT_LINES}, t AS (SELECT doc_id, {case_sql()} AS block_type FROM lines), c AS (SELECT doc_id, block_type, count(*) AS n FROM t WHERE block_type NOT IN ('blank', 'unknown') GROUP BY ALL) SELECT doc_id, max_by(block_type, (n, block_type)) AS dominant FROM c GROUP BY doc_id")
def dominant_type(spark, d):
    kinds = grep.line_table(scripts(spark, d)).select("doc_id", S.line_type(F.col("line")).alias("block_type")).where("block_type not in ('blank', 'unknown')")
    counts = kinds.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.max_by("block_type", F.struct("n", "block_type")).alias("dominant"))


@query("indented_bodies", f"WITH {SCRIPT_LINES}, i AS (SELECT *, length(line) - length(ltrim(line)) AS ind FROM lines WHERE trim(line) <> ''), h AS (SELECT *, sum(CASE WHEN ind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS body FROM i) SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line_start, CAST(max(line_no) AS INTEGER) AS line_end FROM h GROUP BY doc_id, body HAVING count(*) > 1")
def indented_bodies(spark, d):
    """Heads with the deeper lines below them."""
    lines = grep.line_table(scripts(spark, d)).where(F.trim("line") != "").withColumn("ind", F.length("line") - F.length(F.ltrim("line")))
    body = F.count_if(F.col("ind") == 0).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    out = lines.withColumn("body", body).groupBy("doc_id", "body").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count("*").alias("n"))
    return out.where("n > 1").select("doc_id", "line_start", "line_end")


_VARIANTS = (QUERY, "of the thing", "is to be")
_MULTI = ", ".join(_sparse_sql(t, 50).replace("t AS (", f"t{i} AS (", 1).replace("FROM t GROUP", f"FROM t{i} GROUP").replace("c AS (", f"c{i} AS (", 1).replace("w(term", f"w{i}(term").replace("FROM c JOIN w", f"FROM c{i} JOIN w{i}").replace("\n    s AS", f"\n    s{i} AS").replace("sparse AS", f"p{i} AS").replace("FROM s Q", f"FROM s{i} Q") for i, t in enumerate(_VARIANTS))


@query("advanced_rag", f"""WITH {_MULTI}, {_DENSE_SQL}, every AS (SELECT doc_id, rank FROM dense UNION ALL SELECT doc_id, rank FROM p0 UNION ALL SELECT doc_id, rank FROM p1 UNION ALL SELECT doc_id, rank FROM p2),
    fused AS (SELECT min(doc_id) AS doc_id, text, round(sum(1.0 / (10 + rank)), 8) AS score FROM every JOIN documents USING (doc_id) GROUP BY text), top AS (SELECT * FROM fused ORDER BY score DESC, doc_id LIMIT 40),
    o AS (SELECT doc_id, len(list_intersect(list_distinct({_WORDS}), ['the', 'and', 'of', 'thing'])) AS hits FROM top), g AS (SELECT doc_id, round(1 / (1 + exp(-(2 * hits - 5.0))), 6) AS score FROM o)
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, replace('in {{lang}}', '{{lang}}', lang) AS shown FROM (SELECT *, max(score) OVER () AS best FROM g) JOIN documents USING (doc_id) WHERE score >= 0.15 AND score >= 0.4 * best QUALIFY rank <= 10""")
def advanced_rag(spark, d):
    """Hybrid search with variants of the question, merged by content, re-ranked, cut where scores drop off; the first ten, constants filled in."""
    from ..functions import text as T

    docs = table(spark, d, "documents")
    every = _dense(spark, d).select("doc_id", "rank").unionByName(R.sparse_search_all(docs, list(_VARIANTS), 50).select("doc_id", "rank")).join(docs.select("doc_id", "text"), "doc_id")
    merged = every.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.round(F.sum(1.0 / (10 + F.col("rank"))), 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)
    found = merged.withColumn("rank", F.lit(0)).withColumn("q", F.lit(1))
    logit = 2 * F.size(F.array_intersect(T.words(F.col("text")), F.array(*map(F.lit, QUERY.split())))) - 5.0
    kept = R.drop_off(R.rerank(found, lambda r: logit, ["q"], ["doc_id"]), by=["q"]).where("rank <= 10").select("doc_id", "score", "rank")
    shown = S.resolved(F.lit("in {lang}"), F.create_map(F.lit("lang"), "lang"))
    return kept.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "score", "rank", shown.alias("shown"))


@query("network_update", f"WITH {EDGES} SELECT src, dst, type FROM edges WHERE type <> 'imports' UNION ALL SELECT src, dst || '@v2', 'imports' FROM edges WHERE type = 'imports'")
def network_update(spark, d):
    """Edges of one kind replaced by new ones."""
    e = edges(spark, d)
    new = e.where("type = 'imports'").withColumn("dst", F.concat("dst", F.lit("@v2")))
    return G.upsert(e, new, ["src", "type"]).select("src", "dst", "type")


@query("query_variants", "SELECT conv_id, turn, unnest(list_distinct(list_filter([text] || string_split(text, '. '), lambda x: trim(x) <> ''))) AS variant FROM conversations WHERE role = 'user'")
def query_variants(spark, d):
    """A question and its sentences, each once."""
    each = F.array_distinct(F.filter(F.concat(F.array("text"), F.split("text", r"\. ")), lambda x: F.trim(x) != ""))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(each).alias("variant"))


@query("knowledge_bank", "SELECT conv_id, turn // 50 AS part, string_agg('- ' || text, chr(10) ORDER BY turn, text) AS facts, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL")
def knowledge_bank(spark, d):
    """Each conversation's facts as lists of 50 turns at most, so that a long one isn't one row."""
    x = table(spark, d, "conversations").where("role = 'assistant'").withColumn("part", F.expr("turn div 50"))
    facts = F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("t"))))
    return x.groupBy("conv_id", "part").agg(F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f["t"])), "\n").alias("facts"), F.count("*").alias("n"))


@query("action_steps", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, props->>'$.k' AS argument FROM events")
def action_steps(spark, d):
    """The log's step of each action, with its argument."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", n.alias("step"), F.get_json_object("props", "$.k").alias("argument"))


@query("chunk_dependents", "SELECT a.l_orderkey AS src, count(DISTINCT b.l_orderkey) AS dependents FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1")
def chunk_dependents(spark, d):
    """For each definer (order) the later ones that share a name (part) with it."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), "l_partkey").distinct()
    y = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dst"), "l_partkey").distinct()
    return x.join(y, "l_partkey").where("src < dst").groupBy("src").agg(F.countDistinct("dst").alias("dependents"))


@query("line_statistics", f"WITH {LINES} SELECT lang, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank, max(length(line)) AS longest FROM lines GROUP BY lang")
def line_statistics(spark, d):
    x = grep.line_table(table(spark, d, "documents"), ["lang"])
    return x.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.max(F.length("line")).cast("long").alias("longest"))
