"""The dependency graph of the scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import grep, scripts as S
from ..registry import query
from .inputs import BLOCKS, DUCK, REFERENCES, SCRIPT_LINES, case_sql, scripts, table

EDGES = f"{REFERENCES}, edges AS (SELECT path AS src, target AS dst, type FROM refs)"
_FOLDER = "regexp_replace(path, '/[^/]*$', '')"
_NESTED = "'/' || lang || '/' || source || '/' || CAST(doc_id % 7 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR)"


def edges(spark, d):
    return S.references(scripts(spark, d)).select(F.col("path").alias("src"), F.col("target").alias("dst"), "type")


def _paths(spark, d):
    return table(spark, d, "documents").select(F.concat_ws("/", F.lit(""), "lang", "source", (F.col("doc_id") % 7).cast("string"), F.col("doc_id").cast("string")).alias("path"))


@query("edge_type_counts", f"WITH {EDGES} SELECT type, count(*) AS n, count(DISTINCT dst) AS targets FROM edges GROUP BY type")
def edge_type_counts(spark, d):
    return edges(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


@query("edge_occurrences", f"WITH {EDGES} SELECT dst, type, src, count(*) AS n, sum(count(*)) OVER (PARTITION BY dst, type)::BIGINT AS total FROM edges GROUP BY dst, type, src")
def edge_occurrences(spark, d):
    """How often each script holds each edge, and how often the target is met in all: rows, so no target gathers a list."""
    each = edges(spark, d).groupBy("dst", "type", "src").agg(F.count("*").alias("n"))
    total = each.groupBy("dst", "type").agg(F.sum("n").alias("total"))
    return each.join(total, ["dst", "type"]).select("dst", "type", "src", "n", "total")


@query("edge_target_counts", f"WITH {EDGES}, c AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst) SELECT dst, n, CAST(row_number() OVER (ORDER BY n DESC, dst) AS INTEGER) AS place FROM c QUALIFY place <= 20")
def edge_target_counts(spark, d):
    from pyspark.sql.window import Window

    top = edges(spark, d).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "dst")).cast("int"))


@query("folder_ancestors", f"WITH p AS (SELECT string_split({_NESTED}, '/') AS parts FROM documents), a AS (SELECT DISTINCT unnest(['/' || parts[2], '/' || parts[2] || '/' || parts[3], '/' || parts[2] || '/' || parts[3] || '/' || parts[4]]) AS folder FROM p) SELECT folder, CASE WHEN regexp_replace(folder, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(folder, '/[^/]*$', '') END AS parent, CAST(len(string_split(folder, '/')) - 1 AS INTEGER) AS depth FROM a UNION ALL SELECT '/', NULL, 0")
def folder_ancestors(spark, d):
    return G.folders(_paths(spark, d))


@query("contains_edges", f"WITH p AS (SELECT {_NESTED} AS path FROM documents), s AS (SELECT path, string_split(path, '/') AS x FROM p), e AS (SELECT DISTINCT '/' AS src, '/' || x[2] AS dst FROM s UNION SELECT DISTINCT '/' || x[2], '/' || x[2] || '/' || x[3] FROM s UNION SELECT DISTINCT '/' || x[2] || '/' || x[3], '/' || x[2] || '/' || x[3] || '/' || x[4] FROM s UNION SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), path FROM s) SELECT src, dst, 'contains' AS type FROM e")
def contains_edges(spark, d):
    return G.contains_edges(_paths(spark, d))


@query("tree_counts", f"WITH p AS (SELECT string_split({_NESTED}, '/') AS x FROM documents), a AS (SELECT '/' AS folder, 4 AS depth, x FROM p UNION ALL SELECT '/' || x[2], 3, x FROM p UNION ALL SELECT '/' || x[2] || '/' || x[3], 2, x FROM p UNION ALL SELECT '/' || x[2] || '/' || x[3] || '/' || x[4], 1, x FROM p) SELECT folder, count(*) AS files, CAST(CASE max(depth) WHEN 4 THEN count(DISTINCT x[2]) + count(DISTINCT x[2] || '/' || x[3]) + count(DISTINCT x[2] || '/' || x[3] || '/' || x[4]) WHEN 3 THEN count(DISTINCT x[3]) + count(DISTINCT x[3] || '/' || x[4]) WHEN 2 THEN count(DISTINCT x[4]) ELSE 0 END AS BIGINT) AS folders, CAST(max(depth) AS INTEGER) AS max_depth FROM a GROUP BY folder")
def tree_counts(spark, d):
    return G.subtree_counts(_paths(spark, d))


@query("sibling_chain", f"WITH scripts AS ({DUCK}), s AS (SELECT path AS src, lead(path) OVER (PARTITION BY {_FOLDER} ORDER BY path) AS dst, {_FOLDER} AS folder FROM scripts) SELECT src, dst, 'sibling' AS type, folder FROM s WHERE dst IS NOT NULL")
def sibling_chain(spark, d):
    return G.sibling_chain(scripts(spark, d).select("path"), [F.col("path")])


@query("execution_order", f"WITH scripts AS ({DUCK}) SELECT path, CAST(nullif(regexp_extract(regexp_extract(path, '[^/]+$'), '^(\\d+)[\\s._\\-]', 1), '') AS INTEGER) AS execution_order FROM scripts")
def execution_order(spark, d):
    return scripts(spark, d).select("path", T.execution_order(T.base_name(F.col("path"))).alias("execution_order"))


@query("tree_sort", f"WITH scripts AS ({DUCK}) SELECT path, CAST(row_number() OVER (PARTITION BY {_FOLDER} ORDER BY CAST(regexp_extract(path, '/(\\d+)-[^/]*$', 1) AS INT) NULLS LAST, path) AS INTEGER) AS place FROM scripts")
def tree_sort(spark, d):
    """Children by execution order (those without one last), then by name."""
    from pyspark.sql.window import Window

    s = scripts(spark, d)
    w = Window.partitionBy(T.parent(F.col("path"))).orderBy(F.asc_nulls_last(T.execution_order(T.base_name(F.col("path")))), "path")
    return s.select("path", F.row_number().over(w).cast("int").alias("place"))


@query("glob_resolve", f"WITH {EDGES}, f AS (SELECT DISTINCT dst AS file FROM edges WHERE type = 'reads'), n AS (SELECT DISTINCT n_name FROM scripts) SELECT '/jobs/' || n_name AS src, coalesce(file, '/in/' || n_name || '/items-?.csv') AS dst, 'reads' AS type, CASE WHEN file IS NULL THEN NULL ELSE '/in/' || n_name || '/items-*.csv' END AS glob_source FROM n JOIN f ON starts_with(file, '/in/' || n_name || '/items-') UNION ALL SELECT '/jobs/none', '/none/*', 'reads', NULL UNION ALL SELECT '/jobs/plain', '/in/plain.csv', 'reads', NULL")
def glob_resolve(spark, d):
    names = scripts(spark, d).select("n_name").distinct()
    globs = names.select(F.concat(F.lit("/jobs/"), "n_name").alias("src"), F.concat(F.lit("/in/"), "n_name", F.lit("/items-*.csv")).alias("dst"), F.lit("reads").alias("type"))
    more = spark.createDataFrame([("/jobs/none", "/none/*", "reads"), ("/jobs/plain", "/in/plain.csv", "reads")], "src string, dst string, type string")
    files = edges(spark, d).where("type = 'reads'").select(F.col("dst").alias("file")).distinct()
    return G.resolve_globs(globs.unionByName(more), files)


@query("neighbors_all", f"WITH {EDGES} SELECT src AS node, dst AS neighbour, type, 'outgoing' AS direction FROM edges UNION ALL SELECT dst, src, type, 'incoming' FROM edges")
def neighbors_all(spark, d):
    return G.neighbours(edges(spark, d))


@query("neighbors_in", f"WITH {EDGES} SELECT dst AS node, src AS neighbour, type, 'incoming' AS direction FROM edges WHERE type = 'imports'")
def neighbors_in(spark, d):
    return G.neighbours(edges(spark, d), "incoming", ["imports"])


@query("neighbors_out", f"WITH {EDGES} SELECT src AS node, dst AS neighbour, type, 'outgoing' AS direction FROM edges WHERE type IN ('reads', 'writes')")
def neighbors_out(spark, d):
    return G.neighbours(edges(spark, d), "outgoing", ["reads", "writes"])


@query("neighbor_counts", f"WITH {EDGES}, n AS (SELECT src AS node, type, 'out' AS way FROM edges UNION ALL SELECT dst, type, 'in' FROM edges) SELECT node, count(*) AS total, count(*) FILTER (WHERE way = 'in') AS incoming, count(*) FILTER (WHERE way = 'out') AS outgoing, count(*) FILTER (WHERE type = 'reads') AS reads FROM n GROUP BY node")
def neighbor_counts(spark, d):
    n = G.neighbours(edges(spark, d))
    return n.groupBy("node").agg(F.count("*").alias("total"), F.count_if(F.col("direction") == "incoming").alias("incoming"), F.count_if(F.col("direction") == "outgoing").alias("outgoing"), F.count_if(F.col("type") == "reads").alias("reads"))


@query("node_search", f"WITH scripts AS ({DUCK}) SELECT 's' || CAST(doc_id AS VARCHAR) AS id, path, CASE WHEN contains('s' || CAST(doc_id AS VARCHAR), 's1') THEN 'id' WHEN contains(lower(n_name), 's1') THEN 'name' ELSE 'path' END AS field FROM scripts WHERE contains('s' || CAST(doc_id AS VARCHAR), 's1') OR contains(lower(n_name), 's1') OR contains(lower(path), 's1')")
def node_search(spark, d):
    nodes = scripts(spark, d).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.col("n_name").alias("name"), "path")
    return G.search_nodes(nodes, "S1").select("id", "path", "field")


@query("read_lines", f"WITH scripts AS ({DUCK}) SELECT doc_id, array_to_string(string_split(text, chr(10))[3:6], chr(10)) AS part FROM scripts")
def read_lines(spark, d):
    """Lines 3 to 6, ends included."""
    return scripts(spark, d).select("doc_id", F.array_join(F.slice(T.lines(F.col("text")), 3, 4), "\n").alias("part"))


@query("reachability", "WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1), r AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS depth FROM supplier UNION ALL SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 20) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY seed, node")
def reachability(spark, d):
    """What each supplier's script depends on, where each depends on the one of half its number."""
    s = table(spark, d, "supplier")
    e = s.where("s_suppkey > 1").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))
    return G.reach(e, s.select(F.col("s_suppkey").alias("seed")))


@query("path_normalize", r"SELECT doc_id, '/x/' || source || '/[ X ]/' || CAST(doc_id AS VARCHAR) || '.csv' AS path FROM documents")
def path_normalize(spark, d):
    raw = F.concat(F.lit("x\\"), "source", F.lit("//[12]/"), F.col("doc_id").cast("string"), F.lit(".csv"))
    return table(spark, d, "documents").select("doc_id", T.normalized_path(raw).alias("path"))


@query("tree_backoff", f"WITH p AS (SELECT string_split({_NESTED}, '/') AS x FROM documents), l AS (SELECT 1 AS level, count(DISTINCT x[2]) AS rows FROM p UNION ALL SELECT 2, count(DISTINCT x[2]) + count(DISTINCT x[2] || x[3]) FROM p UNION ALL SELECT 3, count(DISTINCT x[2]) + count(DISTINCT x[2] || '/' || x[3]) + count(DISTINCT x[2] || '/' || x[3] || '/' || x[4]) FROM p) SELECT CAST(max(level) FILTER (WHERE rows <= 200) AS INTEGER) AS level FROM l")
def tree_backoff(spark, d):
    """The deepest level of the tree that has 200 rows at most."""
    from pyspark.sql.window import Window

    levels = G.folders(_paths(spark, d)).where("depth > 0").groupBy("depth").agg(F.count("*").alias("n"))
    total = levels.withColumn("rows", F.sum("n").over(Window.orderBy("depth")))
    return total.agg(F.max(F.when(F.col("rows") <= 200, F.col("depth"))).alias("level"))


@query(
    "symbol_nodes",
    rf"""WITH RECURSIVE {SCRIPT_LINES}, i AS (SELECT *, CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END AS ind FROM lines),
t AS (SELECT path || '::table::' || regexp_extract(line, '^\s*table\s+(\w+)', 1) AS id, path AS src, 'table' AS type, trim(line) AS content, line_no AS line_start, line_no AS line_end, CAST([] AS VARCHAR[]) AS qualifiers FROM lines WHERE {case_sql()} = 'table'),
h AS (SELECT *, regexp_extract(line, '^\s*(?:export\s+)?def\s+((?:\w+\s+)*\w+)\s*\(', 1) AS words, coalesce((SELECT min(x.line_no) - 1 FROM i x WHERE x.doc_id = i.doc_id AND x.line_no > i.line_no AND x.ind <= i.ind), (SELECT max(x.line_no) FROM i x WHERE x.doc_id = i.doc_id)) AS last FROM i WHERE regexp_matches(line, '^\s*(?:export\s+)?def\s')),
f AS (SELECT path || '::func::' || string_split(words, ' ')[-1], path, 'function', (SELECT string_agg(x.line, chr(10) ORDER BY x.line_no) FROM i x WHERE x.doc_id = h.doc_id AND x.line_no BETWEEN h.line_no AND h.last), line_no, last, string_split(words, ' ')[:-2] FROM h)
SELECT id, src, type, content, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, qualifiers FROM t UNION ALL SELECT * FROM f""",
)
def symbol_nodes(spark, d):
    """Tables and functions that scripts define, with the script that the edge comes from, their text and their lines."""
    return G.symbol_nodes(scripts(spark, d))


@query("script_nodes", f"WITH scripts AS ({DUCK}) SELECT path AS id, 'script' AS type, regexp_extract(path, '[^/]+$') AS name, path, 'scripts' AS domain, CAST(nullif(regexp_extract(regexp_extract(path, '[^/]+$'), '^(\\d+)[\\s._\\-]', 1), '') AS INTEGER) AS execution_order FROM scripts")
def script_nodes(spark, d):
    return G.script_nodes(scripts(spark, d))


@query(
    "graph_by_domain",
    f"WITH {EDGES}, f AS (SELECT 'scripts' AS domain, path FROM scripts UNION SELECT 'data', dst FROM edges WHERE type <> 'imports'), s AS (SELECT domain, path, string_split(path, '/') AS x FROM f), "
    "fold AS (SELECT DISTINCT domain, array_to_string(x[1:i], '/') AS folder FROM s, range(2, 9) r(i) WHERE i < len(x)), n AS (SELECT domain, {_P} AS folder, count(*) AS c FROM f GROUP BY ALL) "
    "SELECT domain, (SELECT count(*) + 1 FROM fold g WHERE g.domain = n.domain) AS folders, CAST(sum(c) AS BIGINT) AS files, CAST(sum(c - 1) AS BIGINT) AS siblings FROM n GROUP BY domain".replace("{_P}", _FOLDER),
)
def graph_by_domain(spark, d):
    """Folders, files and sibling edges of the two trees: scripts, and the data they read and write."""
    e = edges(spark, d)
    return G.domain_counts({"scripts": scripts(spark, d).select("path").distinct(), "data": e.where("type != 'imports'").select(F.col("dst").alias("path")).distinct()})


@query(
    "import_fallback",
    f"WITH {EDGES}, m AS (SELECT DISTINCT '/libs/common-' || CAST(i AS VARCHAR) AS path, i FROM range(0, 3) r(i) UNION ALL SELECT 'libs/common-' || CAST(i AS VARCHAR), i + 10 FROM range(2, 5) r(i)) "
    "SELECT e.src, e.dst AS raw, coalesce(a.path, b.path, e.dst) AS target, coalesce(a.i, b.i) AS file_id FROM edges e LEFT JOIN m a ON a.path = e.dst LEFT JOIN m b ON b.path = ltrim(e.dst, '/') WHERE e.type = 'imports'",
)
def import_fallback(spark, d):
    """Imported paths looked up as they are, then without the leading slash; else they stay."""
    m = spark.range(0, 3).select(F.concat(F.lit("/libs/common-"), F.col("id").cast("string")).alias("path"), F.col("id").alias("file_id"))
    m = m.unionByName(spark.range(2, 5).select(F.concat(F.lit("libs/common-"), F.col("id").cast("string")).alias("path"), (F.col("id") + 10).alias("file_id")))
    return G.resolve_imports(edges(spark, d).where("type = 'imports'").select("src", F.col("dst").alias("raw")), m)


@query("search_statistics", f"WITH scripts AS ({DUCK}), h AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'script' ELSE 'data_file' END AS type FROM scripts WHERE contains('s' || CAST(doc_id AS VARCHAR), 's1') OR contains(lower(n_name), 's1') OR contains(lower(path), 's1')) SELECT type, count(*) AS matches, (SELECT least(20, count(*)) FROM h) AS total_matches FROM h GROUP BY type")
def search_statistics(spark, d):
    """Counts by type over all matches, and the total of those that the limit (20) lets through."""
    nodes = scripts(spark, d).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.col("n_name").alias("name"), "path", F.when(F.col("doc_id") % 2 == 0, "script").otherwise("data_file").alias("type"))
    return G.search_statistics(nodes, "S1", 20)


@query("siblings_of", f"WITH scripts AS ({DUCK}), s AS (SELECT path AS src, lead(path) OVER (PARTITION BY {_FOLDER} ORDER BY path) AS dst FROM scripts) SELECT src AS node, dst AS neighbour FROM s WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM s WHERE dst IS NOT NULL")
def siblings_of(spark, d):
    """Both neighbours of each script in its folder's chain."""
    chain = G.sibling_chain(scripts(spark, d).select("path"), [F.col("path")]).drop("folder")
    return G.neighbours(edges(spark, d).unionByName(chain), "siblings").select("node", "neighbour")


@query("neighbors_lite", f"WITH {EDGES}, n AS (SELECT dst AS node, type FROM edges UNION ALL SELECT src, type FROM edges UNION ALL SELECT path, 'contains' FROM scripts) SELECT node, count(*) AS total, count(*) FILTER (WHERE type = 'reads') AS reads, count(*) FILTER (WHERE type = 'imports') AS imports, count(*) FILTER (WHERE type = 'writes') AS writes FROM n GROUP BY node")
def neighbors_lite(spark, d):
    """Neighbours by the three groups that are shown; the total counts all kinds but gives folders no row."""
    up = scripts(spark, d).select(T.parent(F.col("path")).alias("src"), F.col("path").alias("dst"), F.lit("contains").alias("type"))
    return G.neighbour_groups(edges(spark, d).unionByName(up))


@query("nodes_by_type", f"WITH {EDGES} SELECT id, type, name FROM (SELECT DISTINCT dst AS id, CASE WHEN type = 'imports' THEN 'script' ELSE 'data_file' END AS type, regexp_extract(dst, '[^/]+$') AS name FROM edges) WHERE type = 'data_file'")
def nodes_by_type(spark, d):
    """Nodes that edges lead to, of one type."""
    return G.nodes_of(edges(spark, d)).where("type = 'data_file'")


@query(
    "subtree_limited",
    f"WITH p AS (SELECT string_split({_NESTED}, '/') AS x FROM documents), a AS (SELECT '/' AS folder, 0 AS depth, NULL AS parent FROM p UNION SELECT '/' || x[2], 1, '/' FROM p UNION SELECT '/' || x[2] || '/' || x[3], 2, '/' || x[2] FROM p) SELECT folder, CAST(depth AS INTEGER) AS depth, parent FROM a WHERE folder = '/' OR starts_with(folder, '/en') ",
)
def subtree_limited(spark, d):
    """The tree below one folder, to the second level."""
    return G.subtree(_paths(spark, d), "/", 2).where("folder = '/' or folder like '/en%'").select("folder", "depth", "parent")


@query(
    "tree_children",
    f"WITH p AS (SELECT string_split({_NESTED}, '/') AS x FROM documents), c AS (SELECT DISTINCT '/' || x[2] || '/' || x[3] AS folder, x[4] AS name, true AS is_folder FROM p UNION SELECT '/' || x[2] || '/' || x[3], x[5] || '-f', false FROM p WHERE x[4] = '0') SELECT folder, name, is_folder, row_number() OVER (PARTITION BY folder ORDER BY is_folder DESC, TRY_CAST(regexp_extract(name, '^(\\d+)-', 1) AS INT) NULLS LAST, name)::INTEGER AS place FROM c",
)
def tree_children(spark, d):
    """Children of a folder: folders first, then by execution order, then by name."""
    x = _paths(spark, d).select(F.split("path", "/").alias("x"))
    folder = F.concat(F.lit("/"), F.col("x")[1], F.lit("/"), F.col("x")[2]).alias("folder")
    c = x.select(folder, F.col("x")[3].alias("name"), F.lit(True).alias("is_folder")).unionByName(x.where("x[3] = '0'").select(folder, F.concat(F.col("x")[4], F.lit("-f")).alias("name"), F.lit(False).alias("is_folder"))).distinct()
    return G.sorted_children(c)


@query(
    "tree_render",
    f"WITH p AS (SELECT DISTINCT string_split({_NESTED}, '/') AS x FROM documents), n AS (SELECT DISTINCT x[1:2] AS x, len(x) > 2 AS inner_ FROM p UNION SELECT DISTINCT x[1:3], len(x) > 3 FROM p UNION SELECT DISTINCT x[1:4], len(x) > 4 FROM p), "
    "r AS (SELECT array_to_string(x[:-2], '/') AS folder, x[-1] AS name, len(x) - 1 AS depth, inner_, row_number() OVER (PARTITION BY x[:-2] ORDER BY x[-1]) AS place, count(*) OVER (PARTITION BY x[:-2]) AS n FROM n) "
    "SELECT folder, depth::INTEGER AS depth, CASE WHEN place > 3 AND depth > 1 THEN '... (' || CAST(n - 3 AS VARCHAR) || ' more items)' ELSE name || CASE WHEN inner_ THEN '/' ELSE '' END END AS shown FROM r WHERE depth <= 2 AND (depth = 1 OR place <= 4)",
)
def tree_render(spark, d):
    """What is shown of the tree with two levels and three children for each folder below the top; a row counts the others."""
    return G.visible_rows(_paths(spark, d), 2, 3)


@query(
    "context_assembly",
    "WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 3 AS dst FROM supplier WHERE s_suppkey > 0), up AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS k FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT up.seed, e.dst, k + 1 FROM up JOIN e ON e.src = up.node WHERE k < 20), "
    "down AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS k FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT down.seed, e.src, k + 1 FROM down JOIN e ON e.dst = down.node WHERE k < 20) SELECT DISTINCT seed, node FROM (SELECT seed, node FROM up UNION ALL SELECT seed, node FROM down)",
)
def context_assembly(spark, d):
    """A chunk with all it depends on and all that depends on it."""
    s = table(spark, d, "supplier")
    e = s.where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 3").alias("dst"))
    return G.context_of(e, s.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("seed")))


@query("edge_endpoints", f"WITH {EDGES} SELECT e.src, e.dst, s.doc_id AS src_id, t.doc_id AS dst_id FROM edges e LEFT JOIN scripts s ON s.path = e.src LEFT JOIN scripts t ON t.path = e.dst")
def edge_endpoints(spark, d):
    """Both ends looked up; what isn't a node is null."""
    n = scripts(spark, d).select("path", "doc_id")
    e = edges(spark, d).select("src", "dst")
    return e.join(n.withColumnsRenamed({"path": "src", "doc_id": "src_id"}), "src", "left").join(n.withColumnsRenamed({"path": "dst", "doc_id": "dst_id"}), "dst", "left").select("src", "dst", "src_id", "dst_id")
