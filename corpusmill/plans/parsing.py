"""Lines to typed blocks, blocks to chunks, constants and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import grep as G
from ..operators import scripts as S
from ..registry import query
from .inputs import BLOCKS, DUCK, LINES, REFERENCES, SCRIPT_LINES, case_sql, scripts, table


@query("classify_lines", f"WITH {SCRIPT_LINES} SELECT {case_sql()} AS block_type, count(*) AS n FROM lines GROUP BY 1")
def classify_lines(spark, d):
    return G.line_table(scripts(spark, d)).groupBy(S.line_type(F.col("line")).alias("block_type")).agg(F.count("*").alias("n"))


@query(
    "parse_scripts",
    f"WITH RECURSIVE {BLOCKS} SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, block_type, name, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, content, dependencies, definitions FROM blocks",
)
def parse_scripts(spark, d):
    return S.parse_scripts(scripts(spark, d))


@query("block_definitions", f"WITH RECURSIVE {BLOCKS} SELECT DISTINCT doc_id, unnest(definitions) AS name FROM blocks")
def block_definitions(spark, d):
    return S.parse_scripts(scripts(spark, d)).select("doc_id", F.explode("definitions").alias("name")).distinct()


@query("left_definitions", r"WITH %s SELECT DISTINCT doc_id, regexp_extract(line, '^[ \t]*([A-Za-z_]\w*)(?:\.[A-Za-z_]\w*)?[ \t]*=', 1) AS name FROM lines WHERE regexp_matches(line, '^[ \t]*([A-Za-z_]\w*)(?:\.[A-Za-z_]\w*)?[ \t]*=')" % SCRIPT_LINES)
def left_definitions(spark, d):
    """What lines assign to, whatever block they are in."""
    names = F.udf(lambda t: S.left_definitions(t or ""), "array<string>", useArrow=True)
    return scripts(spark, d).select("doc_id", F.explode(names("text")).alias("name"))


@query("script_validation", f"WITH s AS ({DUCK}), c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN text || chr(10) || 'f(' WHEN 2 THEN text || repeat(chr(34), 3) ELSE text END AS text FROM s) SELECT doc_id, doc_id % 4 = 3 AS valid, CASE doc_id % 4 WHEN 0 THEN 'no text' WHEN 1 THEN 'brackets don''t match' WHEN 2 THEN 'open quote' END AS error FROM c")
def script_validation(spark, d):
    """Scripts, some of them broken in three ways."""
    m = F.col("doc_id") % 4
    text = F.when(m == 0, F.lit(None)).when(m == 1, F.concat("text", F.lit("\nf("))).when(m == 2, F.concat("text", F.lit('"""'))).otherwise(F.col("text"))
    return S.validate_scripts(scripts(spark, d).select("doc_id", text.alias("text")))


@query("section_ffill", f"WITH {SCRIPT_LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*///\\s*[~=\\-]{{3,}}') THEN trim(regexp_replace(line, '[/~=\\-]+', '', 'g')) END AS own FROM lines) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h")
def section_ffill(spark, d):
    lines = G.line_table(scripts(spark, d))
    name = F.trim(F.regexp_replace("line", r"[/~=\-]+", ""))
    return lines.select("doc_id", "line_no", S.section_of(lines, S.line_type(F.col("line")) == "section_header", name).alias("section"))


@query("strip_comments", f"""WITH scripts AS ({DUCK}) SELECT doc_id, regexp_replace(text, '("(?:[^"\\\\\\n]|\\\\.)*")|(?s:/\\*.*?\\*/)|//[^\\n]*', '\\1 ', 'g') AS code FROM scripts""")
def strip_comments(spark, d):
    return scripts(spark, d).select("doc_id", T.without_comments(F.col("text")).alias("code"))


@query("strip_strings", f"""WITH scripts AS ({DUCK}) SELECT doc_id, regexp_replace(regexp_replace(text, repeat(chr(34), 3) || '(?s:.*?)' || repeat(chr(34), 3), '', 'g'), '"[^"\\n]*"', '', 'g') AS code FROM (SELECT doc_id, replace(text, chr(39), '') AS text FROM scripts)""")
def strip_strings(spark, d):
    s = scripts(spark, d).withColumn("text", F.replace("text", F.lit("'"), F.lit("")))
    return s.select("doc_id", T.without_strings(F.col("text")).alias("code"))


@query(
    "doc_streams",
    f"""WITH s0 AS ({DUCK}), lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(concat(q, chr(10), '  # Guide', chr(10), '/// not a note', chr(10), q, chr(10), replace(text, 'Note = ' || q, q), chr(10), q, chr(10), 'never closed'), chr(10)) AS l FROM (SELECT *, repeat(chr(34), 3) AS q FROM s0))),
m AS (SELECT *, trim(line) AS s, starts_with(trim(line), repeat(chr(34), 3)) AS mark FROM lines), t AS (SELECT *, count(*) FILTER (WHERE mark) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM m),
u AS (SELECT doc_id, min(line_no) AS line_no, 'user' AS stream, string_agg(CASE WHEN mark THEN replace(s, repeat(chr(34), 3), '') ELSE line END, chr(10) ORDER BY line_no) AS note FROM t WHERE mark OR seen % 2 = 1 GROUP BY doc_id, (seen + 1) // 2 HAVING count(*) FILTER (WHERE mark) = 2)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN starts_with(s, '////') THEN 'memos' WHEN starts_with(s, '///') THEN 'structure' ELSE 'business' END AS stream, trim(CASE WHEN starts_with(s, '////') THEN s[5:] ELSE s[4:] END) AS note
FROM t WHERE NOT mark AND seen % 2 = 0 AND (starts_with(s, '///') OR starts_with(s, '//''')) UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), stream, note FROM u""",
)
def doc_streams(spark, d):
    """Notes by the longest mark they begin with, and the blocks between triple quotes."""
    s = scripts(spark, d).withColumn("text", F.concat(F.lit('"""\n  # Guide\n/// not a note\n"""\n'), F.replace("text", F.lit('Note = """'), F.lit('"""')), F.lit('\n"""\nnever closed')))
    return S.doc_streams(G.line_table(s))


@query(
    "symbol_frequency",
    rf"""WITH scripts AS ({DUCK}), s AS (SELECT doc_id, 'variables' AS kind, unnest(regexp_extract_all(text, '(?m)^[ \t]*([A-Z][A-Za-z0-9_]*\.[A-Za-z0-9_]+)[ \t]*=', 1)) AS name FROM scripts UNION ALL SELECT doc_id, 'variables', unnest(regexp_extract_all(text, '\b(Is[A-Z][A-Za-z0-9_]+)\b', 1)) FROM scripts
UNION ALL SELECT doc_id, 'functions', unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:export[ \t]+)?def[ \t]+(?:(?:pure|process|nosort)[ \t]+)*([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM scripts UNION ALL SELECT doc_id, 'variables', unnest(regexp_extract_all(text, '\bconst\s+([A-Za-z0-9_]+)\s*=', 1)) FROM scripts
UNION ALL SELECT doc_id, 'tables', unnest(regexp_extract_all(text, '\bread\s+"[^"\n]*"(?:\s+unsafe)?\s+as\s+([A-Z][A-Za-z0-9_]+)', 1)) FROM scripts) SELECT doc_id, kind, name, count(*) AS n FROM s GROUP BY ALL""",
)
def symbol_frequency(spark, d):
    return S.symbols(scripts(spark, d))


@query("constant_table", rf"""WITH {SCRIPT_LINES} SELECT doc_id, regexp_extract(line, '^\s*const\s+(\w+)', 1) AS name, regexp_extract(line, '"([^"]*)"', 1) AS value FROM lines WHERE regexp_matches(line, '^\s*const\s+\w+\s*=\s*"[^"]*"')""")
def constant_table(spark, d):
    return scripts(spark, d).select("doc_id", F.explode(S.constants(F.col("text"))).alias("name", "value"))


@query(
    "string_variables",
    rf"""WITH RECURSIVE {SCRIPT_LINES}, a AS (SELECT doc_id, line_no, regexp_extract(line, '^[ \t]*(?:const[ \t]+)?(\w+)[ \t]*=', 1) AS name, regexp_extract(line, '=[ \t]*"([^"]*)"', 1) AS raw, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i
 FROM (SELECT * FROM lines UNION ALL SELECT doc_id, '', 1001, 'folder = "/alt/{{folder}}/{{none}}"' FROM scripts UNION ALL SELECT doc_id, '', 1002, '  last = "{{folder}}"' FROM scripts) WHERE regexp_matches(line, '^[ \t]*(?:const[ \t]+)?\w+[ \t]*=[ \t]*"[^"]*"')),
r AS (SELECT doc_id, line_no, name, raw, raw AS value, i, [{{'k': name, 'v': raw}}] AS seen FROM a WHERE i = 1 UNION ALL
 SELECT doc_id, line_no, name, raw, value, i, list_filter(seen, lambda s: s.k <> name) || [{{'k': name, 'v': value}}] FROM (SELECT a.*, r.seen, list_reduce(list_prepend({{'k': '', 'v': a.raw}}, r.seen), lambda x, y: {{'k': '', 'v': replace(x.v, '{{' || y.k || '}}', y.v)}}).v AS value FROM r JOIN a ON a.doc_id = r.doc_id AND a.i = r.i + 1))
SELECT doc_id, name, value, CAST(CASE WHEN line_no > 1000 THEN line_no - 1000 + (SELECT count(*) FROM lines l WHERE l.doc_id = r.doc_id) ELSE line_no END AS INTEGER) AS line_no, value <> raw AS resolved FROM r""",
)
def string_variables(spark, d):
    """Constants and plain variables from top to bottom; here a name is used in its own new value, and another is unknown."""
    more = F.concat("text", F.lit('\nfolder = "/alt/{folder}/{none}"\n  last = "{folder}"'))
    return S.variables(scripts(spark, d).withColumn("text", more))


@query("placeholder_resolve", f"WITH scripts AS ({DUCK}) SELECT doc_id, replace(replace(text, '{{folder}}', '/in/' || n_name), '{{region}}', n_name) AS text FROM scripts")
def placeholder_resolve(spark, d):
    s = scripts(spark, d)
    return s.select("doc_id", S.resolved(F.col("text"), S.constants(F.col("text"))).alias("text"))


@query("placeholder_erase", f"WITH scripts AS ({DUCK}) SELECT doc_id, replace(replace(text, '{{folder}}', '/in/' || n_name), '{{region}}', n_name) || '' AS text FROM scripts")
def placeholder_erase(spark, d):
    """The other way with names that no constant has: they go."""
    s = scripts(spark, d)
    return s.select("doc_id", S.resolved(F.concat("text", F.lit("{nobody}")), S.constants(F.col("text")), unknown="erase").alias("text"))


@query("extract_edges", f"WITH {REFERENCES} SELECT doc_id, path, type, target FROM refs")
def extract_edges(spark, d):
    return S.references(scripts(spark, d))


@query("external_deps", f"WITH RECURSIVE {BLOCKS} SELECT DISTINCT doc_id, unnest(dependencies) AS dependency FROM blocks")
def external_deps(spark, d):
    return S.parse_scripts(scripts(spark, d)).select("doc_id", F.explode("dependencies").alias("dependency")).distinct()


@query(
    "dependency_providers",
    f"""WITH RECURSIVE {BLOCKS}, need AS (SELECT DISTINCT doc_id, block_no, unnest(list_filter(dependencies, lambda x: NOT list_contains(definitions, x))) AS dependency FROM blocks), give AS (SELECT doc_id, block_no, block_type, unnest(definitions) AS dependency FROM blocks)
SELECT DISTINCT doc_id, dependency, (SELECT min_by(block_type, g.block_no) FROM give g WHERE g.doc_id = need.doc_id AND g.dependency = need.dependency) AS provider FROM need""",
)
def dependency_providers(spark, d):
    """The first block of the script that defines what another needs, by its type (null: none does)."""
    blocks = S.parse_scripts(scripts(spark, d)).withColumnRenamed("block_no", "chunk_no")
    found = S.providers(blocks).join(blocks.select("doc_id", F.col("chunk_no").alias("provider"), "block_type"), ["doc_id", "provider"], "left")
    return found.select("doc_id", "dependency", F.col("block_type").alias("provider")).distinct()


def pack_sql(source: str, most: int, overlap: int) -> str:
    """CTEs from `source` (doc_id, i, n tokens, h is header, l lines) to p: each block's chunk, with the chunk's size so far and what it repeats."""
    fifth = most // 5
    return f"""b AS (SELECT *, lag(n, 1) OVER w AS n1, lag(n, 2) OVER w AS n2, lag(n, 3) OVER w AS n3, lag(l, 1) OVER w AS l1, lag(l, 2) OVER w AS l2 FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, 1 AS chunk, n AS size, 1 AS low, h, CAST(0 AS BIGINT) AS again FROM b WHERE i = 1 UNION ALL
 SELECT doc_id, i, chunk + new::INT, CASE WHEN new THEN n + back ELSE size + n END, CASE WHEN new THEN i - c ELSE low END, h, CASE WHEN new THEN back ELSE again END FROM
 (SELECT *, CASE c WHEN 1 THEN n1 WHEN 2 THEN n1 + n2 WHEN 3 THEN n1 + n2 + n3 ELSE 0 END AS back FROM (SELECT *, CASE WHEN h OR before OR NOT f1 THEN 0 WHEN NOT f2 THEN 1 WHEN NOT f3 THEN 2 ELSE 3 END AS c FROM
 (SELECT *, {overlap} > 0 AND n1 <= {fifth} AND n + n1 < {most} AS f1, l1 < {overlap} AND i - 2 >= low AND n2 <= {fifth} AND n + n1 + n2 < {most} AS f2, l1 + l2 < {overlap} AND i - 3 >= low AND n3 <= {fifth} AND n + n1 + n2 + n3 < {most} AS f3 FROM
 (SELECT b.*, p.chunk, p.size, p.low, p.h AS before, p.again, b.h OR p.size + b.n > {most} AS new FROM p JOIN b ON b.doc_id = p.doc_id AND b.i = p.i + 1)))))"""


_LINE_BLOCKS = f"{LINES}, k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines WHERE trim(line) <> ''), src AS (SELECT doc_id, i, length(line) // 3 AS n, NOT regexp_matches(line, '[a-z]') AS h, 1 AS l FROM k)"
_LINE_CHUNKS = "SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_no, CAST(min(i) AS INTEGER) AS first_block, CAST(max(i) AS INTEGER) AS last_block, CAST(max_by(size, i) AS BIGINT) AS tokens, CAST(count(*) AS INTEGER) AS n_blocks, CAST(max(again) AS BIGINT) AS overlap, CAST(min(low) AS INTEGER) AS from_block FROM p GROUP BY doc_id, chunk"


@query("pack_chunks", f"WITH RECURSIVE {_LINE_BLOCKS}, {pack_sql('src', 512, 0)} {_LINE_CHUNKS}")
def pack_chunks(spark, d):
    return C.chunk_lines(table(spark, d, "documents"), 512)


@query("chunk_overlap", f"WITH RECURSIVE {_LINE_BLOCKS}, {pack_sql('src', 512, 2)} {_LINE_CHUNKS}")
def chunk_overlap(spark, d):
    return C.chunk_lines(table(spark, d, "documents"), 512, overlap=2)


_SCRIPT_BLOCKS = f"{BLOCKS}, src AS (SELECT doc_id, block_no AS i, length(content) // 3 AS n, block_type = 'section_header' AS h, length(content) - length(replace(content, chr(10), '')) + 1 AS l FROM blocks)"
_SECTIONS = "sections AS (SELECT doc_id, block_no, last_value(CASE WHEN block_type = 'section_header' THEN coalesce(name, '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no) AS section FROM blocks)"


@query(
    "script_chunks",
    f"""WITH RECURSIVE {_SCRIPT_BLOCKS}, {pack_sql('src', 64, 2)}, {_SECTIONS}, ch AS (SELECT doc_id, chunk, min(i) AS first, max(i) AS last, min(low) AS low, max_by(size, i) AS tokens FROM p GROUP BY doc_id, chunk),
each AS (SELECT ch.*, b.block_no, b.block_type, b.line_start, b.line_end, b.dependencies, b.definitions FROM ch JOIN blocks b ON b.doc_id = ch.doc_id AND b.block_no BETWEEN ch.low AND ch.last),
g AS (SELECT doc_id, chunk, first, last, low, tokens, list(block_type ORDER BY block_no) AS block_types, min(line_start) AS line_start, max(line_end) AS line_end, max(line_start) FILTER (WHERE block_no = first) AS own_from, flatten(list(dependencies)) AS deps, flatten(list(definitions)) AS defs FROM each GROUP BY ALL)
SELECT g.doc_id, CAST(chunk AS INTEGER) AS chunk_no, nullif(s.section, '') AS section, block_types, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(tokens AS BIGINT) AS tokens, CAST(own_from AS INTEGER) AS own_from, CAST(first - low AS INTEGER) AS overlap_blocks,
 CAST(CASE WHEN first > low THEN chunk - 1 END AS INTEGER) AS overlap_with, list_sort(list_distinct(list_filter(deps, lambda x: NOT list_contains(defs, x)))) AS external FROM g JOIN sections s ON s.doc_id = g.doc_id AND s.block_no = g.first""",
)
def script_chunks(spark, d):
    """Scripts to blocks to chunks of 64 tokens (no block is larger) that overlap by two lines."""
    return C.chunk_scripts(scripts(spark, d), 64, 2).select("doc_id", "chunk_no", "section", "block_types", "line_start", "line_end", "tokens", "own_from", "overlap_blocks", "overlap_with", "external")


@query("chunks_by_type", f"WITH RECURSIVE {_SCRIPT_BLOCKS}, {pack_sql('src', 64, 0)}, ch AS (SELECT doc_id, chunk, max_by(size, i) AS tokens, min(i) AS first FROM p GROUP BY doc_id, chunk) SELECT block_type, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 6) AS mean_tokens FROM ch JOIN blocks b ON b.doc_id = ch.doc_id AND b.block_no = ch.first GROUP BY block_type")
def chunks_by_type(spark, d):
    """Chunk statistics by the type of the first block."""
    c = C.chunk_scripts(scripts(spark, d), 64, 0)
    return c.groupBy(F.element_at("block_types", 1).alias("block_type")).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


@query("chunk_validation", f"WITH RECURSIVE {_SCRIPT_BLOCKS}, {pack_sql('src', 64, 0)}, ch AS (SELECT doc_id, chunk, max_by(size, i) AS tokens FROM p GROUP BY doc_id, chunk) SELECT count(*) AS chunks, count(*) FILTER (WHERE tokens > 60) AS oversize, CAST(0 AS BIGINT) AS blank, count(*) FILTER (WHERE tokens > 60) = 0 AS valid FROM ch")
def chunk_validation(spark, d):
    """Chunks made for 64 tokens, held against 60."""
    return C.validate_chunks(C.chunk_scripts(scripts(spark, d), 64, 0), 60)


@query(
    "split_parts",
    f"""WITH RECURSIVE {LINES}, z AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines), s AS (SELECT doc_id, line_no AS i, (length(line) + CASE WHEN line_no < last THEN 1 ELSE 0 END) // 3 AS n FROM z),
d AS (SELECT doc_id FROM documents WHERE length(text) // 3 > 512),
r AS (SELECT s.doc_id, i, n AS total, CAST(1 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS cut_from, CAST(NULL AS BIGINT) AS cut_to FROM s JOIN d USING (doc_id) WHERE i = 1 UNION ALL
 SELECT doc_id, i, CASE WHEN cut THEN (SELECT coalesce(sum(x.n), 0) FROM s x WHERE x.doc_id = y.doc_id AND x.i >= greatest(start, y.i - 2) AND x.i < y.i) ELSE total END + n, CASE WHEN cut THEN greatest(start, i - 2) ELSE start END, CASE WHEN cut THEN start END, CASE WHEN cut THEN i - 1 END
 FROM (SELECT s.doc_id, s.i, s.n, r.total, r.start, r.total + s.n > 0.7 * 512 AS cut FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1) y)
SELECT doc_id, CAST(cut_from AS INTEGER) AS line_start, CAST(cut_to AS INTEGER) AS line_end FROM r WHERE cut_from IS NOT NULL""",
)
def split_parts(spark, d):
    """Texts over the bound as parts of whole lines that overlap by two; all but the last part, which is filled up backwards (see tests)."""

    def ranges(text: str) -> list[tuple[int, int]]:
        lines = text.split("\n")
        return [(a + 1, b) for a, b in C.split_lines([(len(x) + (i < len(lines) - 1)) // 3 for i, x in enumerate(lines)], 512, 2)[:-1]]

    cuts = F.udf(ranges, "array<struct<a: int, b: int>>", useArrow=True)
    docs = table(spark, d, "documents").where(F.floor(F.length("text") / 3) > 512)
    return docs.select("doc_id", F.explode(cuts("text")).alias("p")).select("doc_id", F.col("p.a").alias("line_start"), F.col("p.b").alias("line_end"))


@query("chunk_statistics", f"WITH RECURSIVE {_LINE_BLOCKS}, {pack_sql('src', 512, 0)}, c AS (SELECT doc_id, chunk, max_by(size, i) AS t FROM p GROUP BY ALL) SELECT count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, round(avg(t), 6) AS mean_tokens, count(*) FILTER (WHERE t > 512) AS oversize FROM c")
def chunk_statistics(spark, d):
    c = C.chunk_lines(table(spark, d, "documents"), 512)
    return c.agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.count_if(F.col("tokens") > 512).alias("oversize"))


@query("split_large", f"WITH {LINES}, p AS (SELECT doc_id, line_no, line, range(0, CAST(greatest(0, (length(line) - 1) // 350) + 1 AS BIGINT)) AS cuts FROM lines WHERE length(line) > 500) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(i AS INTEGER) AS part, substr(line, CAST(i * 350 + 1 AS BIGINT), 350) AS piece FROM (SELECT doc_id, line_no, line, unnest(cuts) AS i FROM p)")
def split_large(spark, d):
    lines = G.line_table(table(spark, d, "documents").where(F.length("text") > 500)).where(F.length("line") > 500)
    return lines.select("doc_id", "line_no", F.posexplode(C.split_large(F.col("line"), 500)).alias("part", "piece"))


@query("prepare_text", r"""WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: rtrim(x)) AS k FROM documents), w AS (SELECT doc_id, k, length(array_to_string(k, chr(10))) // 3 AS n FROM l)
SELECT doc_id, array_to_string(CASE WHEN n > 512 THEN k[1:greatest(1, CAST(floor(len(k) * 0.8::DOUBLE * 512 / n) AS INT))] ELSE k END, chr(10)) AS prepared FROM w""")
def prepare_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.prepared(F.col("text")).alias("prepared"))


@query("token_estimates", "SELECT doc_id, length(text) // 3 AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("block_signature", f"WITH RECURSIVE {BLOCKS} SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, block_type || ':' || coalesce(name, '-') || ':' || CAST(line_end - line_start + 1 AS VARCHAR) AS signature FROM blocks")
def block_signature(spark, d):
    b = S.parse_scripts(scripts(spark, d))
    return b.select("doc_id", "block_no", F.concat_ws(":", "block_type", F.coalesce("name", F.lit("-")), (F.col("line_end") - F.col("line_start") + 1).cast("string")).alias("signature"))


@query(
    "function_bodies",
    rf"""WITH {SCRIPT_LINES}, i AS (SELECT *, CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END AS ind FROM lines), h AS (SELECT * FROM i WHERE regexp_matches(line, '^\s*(?:export\s+)?def\s+'))
SELECT h.doc_id, CAST(h.line_no AS INTEGER) AS line_start, CAST(coalesce((SELECT min(x.line_no) - 1 FROM i x WHERE x.doc_id = h.doc_id AND x.line_no > h.line_no AND x.ind <= h.ind), (SELECT max(x.line_no) FROM i x WHERE x.doc_id = h.doc_id)) AS INTEGER) AS line_end FROM h""",
)
def function_bodies(spark, d):
    return S.function_bodies(G.line_table(scripts(spark, d)))


@query(
    "assignment_classes",
    rf"""WITH {SCRIPT_LINES}, a AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, substr(line, instr(line, '=') + 1) AS rhs FROM lines WHERE {case_sql()} = 'assignment')
SELECT doc_id, line_no, CASE WHEN regexp_matches(rhs, '\b(sum|avg|max|min|count|distinct|mode|median)\s*\(') THEN 'aggregation' WHEN regexp_matches(rhs, '\bif\b.*\bthen\b') THEN 'conditional' WHEN regexp_matches(rhs, '[-+*/]') THEN 'calculation' WHEN contains(rhs, chr(34)) THEN 'string'
 WHEN regexp_matches(rhs, '\b(date|today|monday|week|month|year)\b') THEN 'date' ELSE 'simple' END AS kind FROM a""",
)
def assignment_classes(spark, d):
    """The legacy grammar's classes of assignments."""
    lines = G.line_table(scripts(spark, d)).where(S.line_type(F.col("line")) == "assignment")
    return lines.select("doc_id", "line_no", S.assignment_class(F.expr("substring(line, instr(line, '=') + 1)")).alias("kind"))


@query("legacy_sections", f"WITH scripts AS ({DUCK}), x AS (SELECT doc_id, unnest(string_split('a' || chr(10) || text || chr(10) || text, chr(10))) AS line FROM scripts) SELECT doc_id, CAST(3 AS INTEGER) AS sections, min(length(line)) * 0 + 1 AS first_length FROM x GROUP BY doc_id")
def legacy_sections(spark, d):
    """The legacy grammar's sections: what stands between delimiter lines of 20 separators."""
    bar = F.lit("\n//" + "=" * 30 + "\n")
    parts = S.legacy_sections(F.concat(F.lit("a"), bar, "text", bar, F.lit(" \n"), bar, "text"))
    return scripts(spark, d).select("doc_id", F.size(parts).alias("sections"), F.length(parts[0]).cast("long").alias("first_length"))
