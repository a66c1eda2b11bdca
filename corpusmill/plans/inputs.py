"""Scripts made from the driver's tables, by the same SQL in both engines; and SQL that reads scripts for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import scripts as S

_K = "CAST(s_suppkey AS {s})"
_LINES = (
    "'/// ===== Section ' || {k} || ' ====='",
    "'/// Inputs of ' || s_name",
    "'const region = \"' || n_name || '\"'",
    "'const folder = \"/in/{{region}}\"'",
    "'read \"{{folder}}/items-' || {k} || '.csv\" as Items' || {k} || ' with'",
    "'  Id : text'",
    "'  Qty : number'",
    "''",
    "'import \"/libs/common-' || CAST(s_suppkey % 7 AS {s}) || '\" as Lib with'",
    "'  Rate'",
    "'Items' || {k} || '.Total = Items' || {k} || '.Qty * Lib.Rate // line total'",
    "'table Days' || {k} || ' = extend.range(30)'",
    "'where Items' || {k} || '.Qty > ' || {k}",
    "'/// ~~~~~ Outputs ~~~~~'",
    "'show table \"Totals of {{region}}\" with'",
    "'  Items' || {k} || '.Total'",
    "'/* a block comment */ Flag = 1'",
    "'write Items' || {k} || ' as \"/out/{{region}}/totals-' || CAST(s_suppkey % 5 AS {s}) || '.csv\"'",
    "'export const Top' || {k} || ' = max(Items' || {k} || '.Total)'",
    # comments with blank lines between them, a form, open brackets and quotes, a backslash, blank lines inside statements
    "'//// memo ' || {k}",
    "''",
    "'//'' for the ' || n_name || ' team'",
    "'// plain'",
    "'read form with'",
    "'  choice : text'",
    "''",
    "'  amount : number'",
    "'Note = \"\"\"'",
    "'  Fake.Field = free text ' || {k}",
    "'\"\"\"'",
    "'Items' || {k} || '.Cost = round('",
    "'  Items' || {k} || '.Qty *'",
    "'Lib.Rate) // by Vendor.Price'",
    "''",
    "'Late = Items' || {k} || '.Qty + ' || chr(92)",
    "'IsOpen + '",
    "'  Stock' || CAST(s_suppkey % 3 AS {s}) || '.OnHand'",
    "'table Pairs = Orders'",
    "'def pure grow(x : number) with'",
    "'  y = x + 1'",
    "''",
    "'  return y'",
    "'Orders.Line = if IsOpen then Days' || {k} || '.N else Lookup'",
    "'show label \"Now #(region) of #(Orders.Line)\" with'",
    "'  a1b2'",
    "'/// -----'",
    "'/// ----- Last' || {k} || ' -----'",
    "'show upload \"Up\" write:\"/up/{{region}}/u' || CAST(s_suppkey % 4 AS {s}) || '.csv\" with'",
    "'  Items' || {k} || '.Id'",
)


def scripts_sql(string: str) -> str:
    """doc_id, path, text; `string` is the engine's name of the type."""
    k = _K.format(s=string)
    lines = ", ".join((x if string == "VARCHAR" else x.replace("//''", r"//\'")).format(k=k, s=string) for x in _LINES)
    return f"SELECT s_suppkey AS doc_id, '/' || n_name || '/' || CAST(s_suppkey % 10 AS {string}) || '-script' || {k} || '.dsl' AS path, n_name, concat_ws(chr(10), {lines}) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey"


DUCK = scripts_sql("VARCHAR")


def scripts(spark: SparkSession, d: str) -> DataFrame:
    # {supplier} and {nation} are handed over as DataFrames, so no view of the session is touched
    sql = scripts_sql("STRING").replace("{", "{{").replace("}", "}}").replace("FROM supplier JOIN nation", "FROM {supplier} JOIN {nation}")
    return spark.sql(sql, supplier=spark.read.parquet(f"{d}/supplier.parquet"), nation=spark.read.parquet(f"{d}/nation.parquet"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def case_sql(line: str = "line") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{p}') THEN '{n}'" for n, p in S.RULES) + " ELSE 'unknown' END"


#: Lines of all documents, numbered from 1, for DuckDB.
LINES = "lines AS (SELECT doc_id, lang, source, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents))"
SCRIPT_LINES = f"scripts AS ({DUCK}), lines AS (SELECT doc_id, path, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM scripts))"

_QUOTED = r'"""(?s:.*?)"""|"(?:[^"\\]|\\.)*"'
_WORDS = "[" + ", ".join(f"'{w}'" for w in sorted(S.BUILTINS)) + "]"
_COLUMNS = "[" + ", ".join(f"'{w}'" for w in sorted(S.PROPERTIES)) + "]"
_LIKELY = f"length(x) > 1 AND NOT list_contains({_WORDS}, lower(x)) AND NOT list_contains({_COLUMNS}, x)"
#: Blocks of all scripts for DuckDB, read line by line with the state that a reader has; needs WITH RECURSIVE.
BLOCKS = rf"""{SCRIPT_LINES},
k AS (SELECT doc_id, path, line_no, line, {case_sql()} AS kind, CASE WHEN trim(line) = '' THEN 0 ELSE length(line) - length(ltrim(line)) END AS ind,
  (length(line) - length(replace(line, repeat(chr(34), 3), ''))) // 3 % 2 = 1 AS flip, ends_with(rtrim(line), chr(92)) AS back, regexp_replace(line, '{_QUOTED}', '', 'g') AS bare FROM lines),
kd AS (SELECT *, length(regexp_replace(bare, '[^(\[{{]', '', 'g')) - length(regexp_replace(bare, '[^)\]}}]', '', 'g')) AS delta FROM k),
r AS (SELECT doc_id, line_no, line, kind, 1 AS blk, kind AS bk, ind AS base, greatest(0, delta) AS depth, flip AS quoted, back FROM kd WHERE line_no = 1
  UNION ALL SELECT doc_id, line_no, line, kind, blk + n::INT, CASE WHEN n THEN kind WHEN bk = 'section_header' AND kind = 'blank' THEN NULL ELSE bk END, CASE WHEN n THEN ind ELSE base END,
    greatest(0, CASE WHEN n THEN delta ELSE depth + delta END), CASE WHEN n THEN flip ELSE quoted <> flip END, back
  FROM (SELECT kd.doc_id, kd.line_no, kd.line, kd.kind, r.blk, r.bk, kd.ind, r.base, r.depth, kd.delta, r.quoted, kd.flip, kd.back, CASE WHEN r.bk IS NULL THEN kd.kind <> 'blank'
      WHEN r.bk = 'section_header' THEN kd.kind NOT IN ('blank', 'comment', 'section_header') WHEN r.bk = 'comment' THEN kd.kind NOT IN ('blank', 'comment')
      ELSE NOT r.back AND r.depth = 0 AND NOT r.quoted AND kd.ind <= r.base AND kd.kind NOT IN ('blank', 'unknown') END AS n
    FROM r JOIN kd ON kd.doc_id = r.doc_id AND kd.line_no = r.line_no + 1)),
b0 AS (SELECT doc_id, blk AS block_no, max(bk) AS block_type, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT (bk = 'comment' AND kind = 'blank')) AS content,
  max(nullif(trim(regexp_extract(line, '^///\s*[~=\-]+\s*([^~=\-/]*)', 1)), '')) FILTER (WHERE kind = 'section_header') AS header FROM r WHERE bk IS NOT NULL GROUP BY doc_id, blk),
b1 AS (SELECT *, nullif(CASE block_type WHEN 'section_header' THEN header WHEN 'import' THEN regexp_extract(content, '\sas\s+(\w+)', 1) WHEN 'read' THEN regexp_extract(content, '\sas\s+([A-Za-z_]\w*)', 1)
    WHEN 'write' THEN regexp_extract(content, 'write\s+([A-Za-z_]\w*)', 1) WHEN 'const' THEN regexp_extract(content, 'const\s+(\w+)\s*=', 1) WHEN 'export' THEN regexp_extract(content, 'export\s+(?:const\s+)?(?:table\s+)?(\w+)', 1)
    WHEN 'table' THEN regexp_extract(content, 'table\s+(\w+)\s*(?:\[[^\]]*\])?\s*=', 1) WHEN 'show' THEN regexp_extract(content, 'show\s+\w+\s+"([^"]+)"', 1) WHEN 'assignment' THEN regexp_extract(content, '^\s*([A-Za-z0-9_]+)', 1) END, '') AS name,
  CASE WHEN contains(content, '=') THEN substr(content, instr(content, '=') + 1) ELSE '' END AS rhs FROM b0),
b2 AS (SELECT *, CASE WHEN block_type IN ('show', 'filter') THEN content WHEN block_type IN ('const', 'export', 'table', 'assignment') THEN rhs ELSE '' END AS part,
  CASE WHEN block_type IN ('read', 'write') THEN content WHEN block_type = 'const' THEN rhs ELSE '' END AS paths FROM b1),
b3 AS (SELECT *, regexp_replace(part, '{_QUOTED}', '""', 'g') AS bare FROM b2),
b4 AS (SELECT *, regexp_extract_all(bare, '\b([A-Za-z0-9_]+)\.([A-Za-z_][A-Za-z0-9_]*)', 1) AS owners, regexp_extract_all(bare, '\b([A-Za-z0-9_]+)\.([A-Za-z_][A-Za-z0-9_]*)', 2) AS fields,
  regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '//[^\n]*', '', 'g'), ':\s*[A-Z][A-Za-z0-9_]*\s*(,|\n|$)', '\1', 'g'), '\bas\s+[A-Z][A-Za-z0-9_]*\b', '', 'g'), '(?m)^\s*[A-Z][A-Za-z0-9_]*\s*=', '', 'g'), '\b[A-Z][A-Za-z0-9_]{{2,}}\b') AS capitals FROM b3),
b5 AS (SELECT *, list_filter(owners, lambda x: {_LIKELY}) || list_filter(capitals, lambda x: NOT list_contains(fields, x) AND {_LIKELY}) || regexp_extract_all(paths, '\{{(\w+)\}}', 1)
    || list_filter(regexp_extract_all(part, '#\(([A-Za-z_]\w*)(?:\.\w+)?\)', 1), lambda x: length(x) > 1 AND NOT list_contains({_WORDS}, lower(x))) || CASE WHEN block_type = 'write' THEN [name] ELSE [] END AS refs,
  CASE WHEN block_type IN ('import', 'read', 'const', 'export', 'table', 'assignment') AND name IS NOT NULL THEN [name] ELSE [] END
    || CASE WHEN block_type = 'import' THEN regexp_extract_all(regexp_replace(content, '^(?s:.*?)\swith\s', ''), '(?m)^\s*([A-Za-z_]\w*)\s*$', 1) WHEN block_type = 'form_read' THEN regexp_extract_all(content, '(?m)^\s*([A-Za-z_]\w*)\s*:\s*\w+', 1) ELSE [] END AS defs FROM b4),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS block_no, block_type, name, line_start, line_end, content,
  list_sort(list_distinct(CASE WHEN block_type IN ('export', 'table') OR (block_type = 'assignment' AND NOT regexp_matches(content, '^\s*\w+\.')) THEN list_filter(refs, lambda x: NOT list_contains(defs, x)) ELSE refs END)) AS dependencies,
  list_sort(list_distinct(defs)) AS definitions FROM b5)"""

_RESOLVED = "list_reduce(list_prepend({'k': '', 'v': raw}, cs || cs || cs || cs), lambda a, b: {'k': '', 'v': replace(a.v, '{' || b.k || '}', b.v)}).v"
_FOUND = r"""found AS (SELECT doc_id, path, 'reads' AS type, regexp_extract(line, '^\s*read\b[^"]*"([^"]+)"', 1) AS raw FROM lines UNION ALL SELECT doc_id, path, 'writes', regexp_extract(line, '^\s*write\b[^"]*"([^"]+)"', 1) FROM lines
  UNION ALL SELECT doc_id, path, 'writes', regexp_extract(line, '^\s*show\b.*\bwrite\s*:\s*"([^"]+)"', 1) FROM lines UNION ALL SELECT doc_id, path, 'imports', regexp_extract(line, '^\s*import\b[^"]*"([^"]+)"', 1) FROM lines)"""
#: What scripts read, write and import, for DuckDB: (doc_id, path, type, target).
REFERENCES = rf"""{SCRIPT_LINES}, cl AS (SELECT doc_id, list({{'k': regexp_extract(line, '^\s*const\s+(\w+)', 1), 'v': regexp_extract(line, '"([^"]*)"', 1)}} ORDER BY line_no) AS cs FROM lines WHERE regexp_matches(line, '^\s*const\s+\w+\s*=\s*"') GROUP BY doc_id),
{_FOUND}, resolved AS (SELECT doc_id, path, type, regexp_replace({_RESOLVED}, '\{{\w*\}}', '*', 'g') AS p FROM found JOIN cl USING (doc_id) WHERE raw <> ''),
slashed AS (SELECT doc_id, path, type, regexp_replace(replace(regexp_replace(p, '\[\s*\d+\s*\]', '[ X ]', 'g'), chr(92), '/'), '/{{2,}}', '/', 'g') AS p FROM resolved),
refs AS (SELECT doc_id, path, type, CASE WHEN regexp_matches(p, '[/.]') AND NOT starts_with(p, '/') THEN '/' || p ELSE p END AS target FROM slashed)"""
