"""Search in lines and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grep as G
from ..operators import scripts as S
from ..registry import query
from .inputs import BLOCKS, DUCK, LINES, SCRIPT_LINES, case_sql, scripts, table

P = "licen[sc]e"



@query("grep_lines", f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines WHERE regexp_matches(line, '{P}', 'i')")
def grep_lines(spark, d):
    return G.grep_lines(table(spark, d, "documents"), f' "{P}" ')


@query("grep_literal", f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines WHERE contains(line, '(858') ")
def grep_literal(spark, d):
    """A pattern that doesn't compile is taken literally."""
    return G.grep_lines(table(spark, d, "documents"), "(858").select("doc_id", "line_no")


@query("grep_blocks_by_type", f"WITH {SCRIPT_LINES}, b AS (SELECT *, {case_sql()} AS block_type FROM lines) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, block_type, line AS content FROM b WHERE block_type IN ('read', 'write') AND regexp_matches(line, 'items', 'i')")
def grep_blocks_by_type(spark, d):
    blocks = G.line_table(scripts(spark, d)).withColumn("block_type", S.line_type(F.col("line"))).withColumnRenamed("line", "content")
    return G.grep_blocks(blocks, "items", ["read", "write", "nonsense"], [n for n, _ in S.RULES]).select("doc_id", "line_no", "block_type", "content")


@query("grep_source_filter", f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, source FROM lines WHERE regexp_matches(line, '{P}', 'i') AND regexp_matches(source, 'SRC1[0-4]', 'i')")
def grep_source_filter(spark, d):
    blocks = G.line_table(table(spark, d, "documents"), ["doc_id", "source"]).withColumnRenamed("line", "content")
    return G.grep_blocks(blocks, P, source="SRC1[0-4]").select("doc_id", "line_no", "source")


@query("grep_counts", f"WITH {LINES} SELECT doc_id, count(*) AS matches, list(CAST(line_no AS INTEGER) ORDER BY line_no) AS line_nos, left(min_by(line, line_no), 80) AS preview FROM lines WHERE regexp_matches(line, '{P}', 'i') GROUP BY doc_id")
def grep_counts(spark, d):
    hits = G.grep_lines(table(spark, d, "documents"), P)
    return hits.groupBy("doc_id").agg(F.count("*").alias("matches"), F.sort_array(F.collect_list("line_no")).alias("line_nos"), F.substring(F.min_by("line", "line_no"), 1, 80).alias("preview"))


@query("grep_totals", f"WITH {LINES} SELECT count(*) AS matches, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources FROM lines WHERE regexp_matches(line, '{P}', 'i')")
def grep_totals(spark, d):
    return G.grep_lines(table(spark, d, "documents"), P, ["doc_id", "source"]).agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("sources"))


@query("grep_by_source", f"WITH {LINES}, m AS (SELECT source, doc_id, count(*) AS matches FROM lines WHERE regexp_matches(line, '{P}', 'i') GROUP BY ALL) SELECT source, doc_id, matches, sum(matches) OVER (PARTITION BY source)::BIGINT AS in_source FROM m")
def grep_by_source(spark, d):
    """Documents by source with their matches and the source's: rows, so that no source gathers a list."""
    each = G.grep_lines(table(spark, d, "documents"), P, ["doc_id", "source"]).groupBy("source", "doc_id").agg(F.count("*").alias("matches"))
    total = each.groupBy("source").agg(F.sum("matches").alias("in_source")).withColumnRenamed("source", "s")
    return each.join(total, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "matches", "in_source")


@query("grep_truncated", f"WITH {LINES}, h AS (SELECT '/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INTEGER) AS line_no FROM lines WHERE regexp_matches(line, 'tion', 'i')) SELECT * FROM h ORDER BY path, line_no LIMIT 50")
def grep_truncated(spark, d):
    """The first 50 matches by path and line: the limit is the feature."""
    hits = G.grep_lines(table(spark, d, "documents"), "tion", ["doc_id", "lang", "source"])
    return hits.select(F.concat_ws("/", F.lit(""), "lang", "source", F.col("doc_id").cast("string")).alias("path"), "line_no").orderBy("path", "line_no").limit(50)


@query("grep_context_window", f"""WITH {LINES}, m AS (SELECT *, regexp_matches(line, '{P}', 'i') AS is_match FROM lines), n AS (SELECT *, max(is_match::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, is_match, coalesce(line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 1, false) AS gap_before FROM n WHERE near = 1""")
def grep_context_window(spark, d):
    return G.with_context(table(spark, d, "documents"), P, 2)


@query("optimal_context_k", f"""WITH {LINES}, m AS (SELECT doc_id, line_no, regexp_matches(line, 'tion', 'i') AS hit FROM lines), n AS (SELECT doc_id, max(line_no) AS n, list(line_no ORDER BY line_no) FILTER (WHERE hit) AS ms FROM m GROUP BY doc_id HAVING count(*) FILTER (WHERE hit) > 0),
w AS (SELECT doc_id, k, list_sum(list_transform(range(2, len(ms) + 1), lambda i: least(ms[i] - ms[i - 1], 2 * k + 1) + (CASE WHEN ms[i] - ms[i - 1] > 2 * k + 1 THEN 1 ELSE 0 END))) AS inner_, ms, n FROM n, range(0, 201) r(k)),
t AS (SELECT doc_id, k, least(ms[1] - 1, k) + 1 + coalesce(inner_, 0) + least(n - ms[-1], k) AS total FROM w), u AS (SELECT *, lag(total) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM t)
SELECT doc_id, CAST(coalesce(min(k) FILTER (WHERE k >= 2 AND total = before AND total <= 150), max(k) FILTER (WHERE total <= 150), 0) AS INTEGER) AS k FROM u GROUP BY doc_id""")
def optimal_context_k(spark, d):
    p = G.pattern("tion")
    docs = table(spark, d, "documents").where(G.may_match(F.col("text"), p)).select("doc_id", T.lines(F.col("text")).alias("ls"))
    hits = docs.select("doc_id", F.size("ls").alias("n"), F.expr(f"filter(transform(ls, (x, i) -> if(x rlike '{p}', i + 1, null)), x -> x is not null)").alias("ms"))
    return hits.where(F.size("ms") > 0).select("doc_id", G.context_size(F.col("ms"), F.col("n")).alias("k"))


@query("script_finder", f"WITH scripts AS ({DUCK}), t(target) AS (VALUES ('script1'), ('SCRIPT2'), ('3-script')) SELECT doc_id, path, target FROM scripts JOIN t ON regexp_matches(path, target, 'i')")
def script_finder(spark, d):
    targets = spark.createDataFrame([("script1",), ("SCRIPT2",), ("3-script",)], "target string")
    return G.find_scripts(scripts(spark, d).select("doc_id", "path"), targets)


@query("reference_scan", f"""WITH scripts AS ({DUCK}), r AS (SELECT doc_id, replace(replace(text, '{{folder}}', '/in/' || n_name), '{{region}}', n_name) AS text FROM scripts), lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM r))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(nullif(regexp_extract(line, '\\b(read|write|import)\\s*:?\\s*"([^"]*)"', 2), ''), nullif(regexp_extract(line, '"([^"]+)"', 1), '')) AS reference FROM lines WHERE regexp_matches(line, '"[^"]+"')""")
def reference_scan(spark, d):
    """One reference a line: the path after a verb, else any quoted literal; constants filled in."""
    s = scripts(spark, d).withColumn("text", S.resolved(F.col("text"), S.constants(F.col("text"))))
    verb, any_ = F.regexp_extract("line", r'\b(read|write|import)\s*:?\s*"([^"]*)"', 2), F.regexp_extract("line", '"([^"]+)"', 1)
    return G.line_table(s).where(F.col("line").rlike('"[^"]+"')).select("doc_id", "line_no", F.coalesce(F.nullif(verb, F.lit("")), F.nullif(any_, F.lit(""))).alias("reference"))


@query("suffix_path_match", f"WITH scripts AS ({DUCK}), t(target) AS (VALUES ('5-script5.dsl'), ('x/7-script17')), b AS (SELECT doc_id, path, target, regexp_replace(path, '\\.[^./]*$', '') AS p, regexp_replace(target, '\\.[^./]*$', '') AS q FROM scripts, t) SELECT doc_id, path, target FROM b WHERE ends_with(p, q) OR ends_with(q, p)")
def suffix_path_match(spark, d):
    """Without extensions, either is the other's end."""
    t = spark.createDataFrame([("5-script5.dsl",), ("x/7-script17",)], "target string")
    return G.suffix_matches(scripts(spark, d).select("doc_id", "path"), t)


@query(
    "path_search",
    f"""WITH scripts AS ({DUCK}), r AS (SELECT doc_id, replace(replace(text, '{{folder}}', '/in/' || n_name), '{{region}}', n_name) AS text FROM scripts), lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM r)),
x AS (SELECT doc_id, line_no, regexp_extract(line, '\\b(read|write|import)\\s*:?\\s*"([^"]*)"', 1) AS verb, regexp_extract(line, '\\b(read|write|import)\\s*:?\\s*"([^"]*)"', 2) AS said, regexp_extract_all(line, '"([^"]*)"', 1) AS ls FROM lines)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN said LIKE '%NATION_1%' AND verb <> '' THEN verb ELSE 'literal' END AS verb, CASE WHEN said LIKE '%/NATION_1%' AND verb <> '' THEN said ELSE list_filter(ls, lambda t: t LIKE '%/NATION_1%')[1] END AS resolved FROM x WHERE len(list_filter(ls, lambda t: t LIKE '%/NATION_1%')) > 0""".replace("said LIKE '%NATION_1%'", "said LIKE '%/NATION_1%'"),
)
def path_search(spark, d):
    """Lines that refer to a path that is spelled out nowhere, only through constants."""
    return G.path_search(scripts(spark, d), "[/]nation_1")


@query("grep_resolved", f"WITH RECURSIVE {BLOCKS} SELECT b.doc_id, b.block_no FROM blocks b JOIN scripts s USING (doc_id) WHERE regexp_matches(replace(replace(b.content, '{{folder}}', '/in/' || s.n_name), '{{region}}', s.n_name), 'in/nation_1\\d/items', 'i')")
def grep_resolved(spark, d):
    """Blocks that match a path after their script's constants are filled in."""
    s = scripts(spark, d)
    b = S.parse_scripts(s).join(s.select("doc_id", S.constants(F.col("text")).alias("consts")), "doc_id")
    return G.grep_resolved(b, r"in/nation_1\d/items", F.col("consts")).select("doc_id", F.col("block_no").cast("long").alias("block_no"))


@query("source_substring_filter", "SELECT doc_id, source FROM documents WHERE contains(source, 'c1') OR contains(source, 'src7')")
def source_substring_filter(spark, d):
    subs = F.array(F.lit("c1"), F.lit("src7"))
    return table(spark, d, "documents").where(F.exists(subs, lambda s: F.contains("source", s))).select("doc_id", "source")


@query("keyword_ratio", "SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'ung') AS INT) AS hits FROM documents")
def keyword_ratio(spark, d):
    keys = F.array(*map(F.lit, ("The", "que", "ung")))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(keys, lambda k: F.contains(F.lower("text"), F.lower(k)))).alias("hits"))


@query("route_questions", r"""SELECT conv_id, turn, CASE WHEN p IS NOT NULL OR w THEN 'grep' ELSE 'semantic' END AS tool, CASE WHEN p IS NOT NULL THEN 0.95::DOUBLE WHEN w THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END AS confidence, coalesce(p, c, q) AS pattern FROM
(SELECT conv_id, turn, nullif(regexp_extract(text, '(/[\p{L}\p{N}_./-]+)', 1), '') AS p, nullif(regexp_extract(text, '\b([A-Z][a-z]+[A-Z][A-Za-z]*)', 1), '') AS c, nullif(regexp_extract(text, '"([^"]+)"', 1), '') AS q, regexp_matches(lower(text), '(^|[^a-z])(find|list|where|which files|occurrences)([^a-z]|$)') AS w FROM conversations WHERE role = 'user')""")
def route_questions(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", G.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")
