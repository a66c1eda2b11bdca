"""A dependency graph as two tables: nodes (id, type, name, path) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..shared import cut


def folders(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Every folder above the paths, the root "/" too: (folder, parent, depth)."""
    up = paths.select(F.explode(T.ancestors(F.col(path_col))).alias("folder"), path_col).where("folder != " + path_col).select("folder").distinct()
    out = up.select("folder", F.when(T.parent(F.col("folder")) == "", "/").otherwise(T.parent(F.col("folder"))).alias("parent"), (F.size(F.split("folder", "/")) - 1).alias("depth"))
    return out.unionByName(paths.sparkSession.createDataFrame([("/", None, 0)], "folder string, parent string, depth int"))


def contains_edges(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(src, dst, type): folder to folder and folder to file."""
    inner = folders(paths, path_col).where("parent is not null").select(F.col("parent").alias("src"), F.col("folder").alias("dst"))
    leaf = paths.select(F.when(T.parent(F.col(path_col)) == "", "/").otherwise(T.parent(F.col(path_col))).alias("src"), F.col(path_col).alias("dst")).distinct()
    return inner.unionByName(leaf).withColumn("type", F.lit("contains"))


def sibling_chain(paths: DataFrame, order: list[Column], path_col: str = "path") -> DataFrame:
    """Each file with the next of its folder."""
    w = Window.partitionBy("folder").orderBy(*order)
    out = paths.withColumn("folder", T.parent(F.col(path_col))).withColumn("dst", F.lead(path_col).over(w))
    return out.where("dst is not null").select(F.col(path_col).alias("src"), "dst", F.lit("sibling").alias("type"), "folder")


def resolve_globs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges to a glob go to all files it matches; a glob that matches none keeps its edge. files: (file).

    A glob and its files share the folder before the first wildcard, so they meet by that folder, not all with all.
    """
    globs = edges.where(F.contains("dst", F.lit("*")))
    plain = edges.join(globs.select("dst").distinct(), "dst", "left_anti").select(*edges.columns).withColumn("glob_source", F.lit(None).cast("string"))
    asked = globs.select(F.col("dst").alias("glob"), T.glob_regex(F.col("dst")).alias("re"), F.regexp_extract("dst", r"^([^*?]*)/", 1).alias("folder")).distinct()
    above = files.select("file", F.explode(F.concat(F.array(F.lit("")), T.ancestors(T.parent(F.col("file"))))).alias("folder")).distinct()
    found = above.join(asked, "folder").where("file rlike re").select("glob", "file").distinct()
    hit = globs.join(found, globs["dst"] == found["glob"], "left")
    return plain.unionByName(hit.select("src", F.coalesce("file", "dst").alias("dst"), "type", F.col("glob").alias("glob_source")))


def neighbours(edges: DataFrame, direction: str = "all", types: list[str] | None = None) -> DataFrame:
    """(node, neighbour, type, direction); siblings have no direction, a loop counts both ways."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "type", F.lit("outgoing").alias("direction"))
    in_ = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "type", F.lit("incoming").alias("direction"))
    both = out.unionByName(in_)
    chosen = {"outgoing": out, "incoming": in_, "all": both, "siblings": both.where("type = 'sibling'")}[direction]
    return chosen.withColumn("direction", F.when(F.col("type") == "sibling", "both").otherwise(F.col("direction")))


def neighbour_groups(edges: DataFrame) -> DataFrame:
    """(node, total, reads, imports, writes): the total counts every kind; ends at a folder (of contains) have no row."""
    n = neighbours(edges).where("not (type = 'contains' and direction = 'outgoing')")
    return n.groupBy("node").agg(F.count("*").alias("total"), *(F.count_if(F.col("type") == t).alias(t) for t in ("reads", "imports", "writes")))


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id, type, name) of what edges lead to: imports to scripts, others to data files."""
    kind = F.when(F.col("type") == "imports", "script").otherwise("data_file")
    return edges.select(F.col("dst").alias("id"), kind.alias("type"), T.base_name(F.col("dst")).alias("name")).distinct()


def script_nodes(scripts: DataFrame) -> DataFrame:
    """(id, type, name, path, domain, execution_order): a node for each script, under its logical path."""
    name = T.base_name(F.col("path"))
    return scripts.select(F.col("path").alias("id"), F.lit("script").alias("type"), name.alias("name"), "path", F.lit("scripts").alias("domain"), T.execution_order(name).alias("execution_order"))


def symbol_nodes(scripts: DataFrame) -> DataFrame:
    """(id, src, type, content, line_start, line_end, qualifiers): tables by their line, functions with their bodies and the words before their names."""
    from .grep import line_table
    from .scripts import function_bodies, line_type

    lines = line_table(scripts, ["doc_id", "path"])
    none = F.array().cast("array<string>")
    tables = lines.where(line_type(F.col("line")) == "table").select(
        F.concat_ws("::", "path", F.lit("table"), F.regexp_extract("line", r"^\s*table\s+(\w+)", 1)).alias("id"), F.col("path").alias("src"), F.lit("table").alias("type"), F.trim("line").alias("content"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), none.alias("qualifiers")
    )
    words = F.split(F.regexp_extract("line", r"^\s*(?:export\s+)?def\s+((?:\w+\s+)*\w+)\s*\(", 1), r"\s+")
    ends = function_bodies(lines.select("doc_id", "line_no", "line"))
    heads = ends.join(lines, ["doc_id"]).where(F.col("line_no").between(F.col("line_start"), F.col("line_end")))
    body = heads.groupBy("doc_id", "path", "line_start", "line_end").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))  # a function's own lines
    named = body.withColumn("line", F.col("ls")[0]["line"]).withColumn("words", words)
    functions = named.select(
        F.concat_ws("::", "path", F.lit("func"), F.element_at("words", -1)).alias("id"), F.col("path").alias("src"), F.lit("function").alias("type"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"), "line_start", "line_end", F.slice("words", 1, F.size("words") - 1).alias("qualifiers")
    )
    return tables.unionByName(functions)


def domain_counts(paths: dict[str, DataFrame]) -> DataFrame:
    """(domain, folders, files, siblings) of trees that share nothing; siblings count the links of each folder's chain, folders the root too."""
    out = None
    for domain, p in paths.items():
        each = p.groupBy(T.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("c")).agg(F.sum("c").alias("files"), F.sum(F.col("c") - 1).alias("siblings"))
        one = folders(p).agg(F.count("*").alias("folders")).join(each).select(F.lit(domain).alias("domain"), "folders", "files", "siblings")
        out = one if out is None else out.unionByName(one)
    return out


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(src, raw, target, file_id): known paths as they are, else without the leading slash, else raw. known: (path, file_id)."""
    a = known.select(F.col("path").alias("p1"), F.col("file_id").alias("i1"))
    b = known.select(F.col("path").alias("p2"), F.col("file_id").alias("i2"))
    x = imports.join(a, F.col("raw") == F.col("p1"), "left").join(b, F.expr("ltrim('/', raw)") == F.col("p2"), "left")
    return x.select("src", "raw", F.coalesce("p1", "p2", "raw").alias("target"), F.coalesce("i1", "i2").alias("file_id"))


def search_statistics(nodes: DataFrame, text: str, top: int = 20) -> DataFrame:
    """(type, matches, total_matches): by type over all matches, the total after the limit."""
    by = search_nodes(nodes, text).groupBy("type").agg(F.count("*").alias("matches"))
    shown = search_nodes(nodes, text).agg(F.least(F.lit(top).cast("long"), F.count("*")).alias("total_matches"))
    return by.join(shown)  # one row


def subtree(paths: DataFrame, root: str, most_depth: int) -> DataFrame:
    """Folders below (and with) the root, most_depth levels deep: (folder, parent, depth), depth from the root."""
    base = 0 if root == "/" else root.count("/")
    x = folders(paths).where((F.col("folder") == root) | F.startswith("folder", F.lit(root.rstrip("/") + "/")))
    return x.withColumn("depth", F.col("depth") - base).where(F.col("depth") <= most_depth)


def sorted_children(children: DataFrame) -> DataFrame:
    """(folder, name, is_folder, place): folders first, then the execution order (without one last), then the name."""
    w = Window.partitionBy("folder").orderBy(F.desc("is_folder"), F.asc_nulls_last(T.execution_order(F.col("name"))), "name")
    return children.withColumn("place", F.row_number().over(w).cast("int"))


def visible_rows(paths: DataFrame, most_depth: int, most_children: int) -> DataFrame:
    """(folder, depth, shown): names down to a depth, folders with a slash; below the top a folder shows most_children and how many more there are."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    up = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("f"), F.get(parts, i - 1).alias("name"), (i < F.size(parts)).alias("inner")))).alias("x"))
    rows = up.select("x.*").where(F.col("depth") <= most_depth).select("depth", F.when(F.col("f") == "", "").otherwise(F.concat(F.lit("/"), "f")).alias("folder"), "name", "inner").distinct()
    place = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    counts = rows.groupBy("folder").agg(F.count("*").alias("n"))
    x = rows.withColumn("place", place).where((F.col("depth") == 1) | (F.col("place") <= most_children + 1)).join(counts, "folder")
    more = F.concat(F.lit("... ("), (F.col("n") - most_children).cast("string"), F.lit(" more items)"))
    shown = F.when((F.col("place") > most_children) & (F.col("depth") > 1), more).otherwise(F.concat("name", F.when(F.col("inner"), "/").otherwise("")))
    return x.select("folder", "depth", shown.alias("shown"))


def context_of(edges: DataFrame, seeds: DataFrame, dependencies: bool = True, dependents: bool = True) -> DataFrame:
    """(seed, node): each seed with what it depends on and what depends on it, at any distance."""
    out = seeds.select("seed", F.col("seed").alias("node"))
    if dependencies:
        out = out.unionByName(reach(edges, seeds).select("seed", "node"))
    if dependents:
        out = out.unionByName(reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds).select("seed", "node"))
    return out.distinct()


def reach(edges: DataFrame, seeds: DataFrame, most_depth: int = 20) -> DataFrame:
    """(seed, node, depth): all that can be reached, with the least depth. seeds: (seed). Frontiers are joined level by level; a node found once isn't followed again."""
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    front = found
    for depth in range(1, most_depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(found, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        front = cut(front, "frontier")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def subtree_counts(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(folder, files, folders, max_depth) below each folder, the root included."""
    parts = F.size(F.split(path_col, "/")) - 1
    above = F.concat(F.array(F.lit("/")), F.filter(T.ancestors(F.col(path_col)), lambda a: a != F.col(path_col)))
    each = paths.select(path_col, parts.alias("depth"), F.explode(above).alias("folder"))
    level = F.when(F.col("folder") == "/", 0).otherwise(F.size(F.split("folder", "/")) - 1)
    files = each.groupBy("folder").agg(F.count("*").alias("files"), F.max(F.col("depth") - level).cast("int").alias("max_depth"))
    subs = folders(paths, path_col).where("folder != '/'").select(F.col("folder").alias("sub"), F.explode(F.concat(F.array(F.lit("/")), T.ancestors(F.col("folder")))).alias("folder")).where("sub != folder").groupBy("folder").agg(F.count("*").alias("folders"))
    return files.join(subs, "folder", "left").select("folder", "files", F.coalesce("folders", F.lit(0)).alias("folders"), "max_depth")


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes with the text in id, name or path (any case), and the first field that has it."""
    t = F.lit(text.lower())
    hit = [F.contains(F.lower(F.coalesce(c, F.lit(""))), t) for c in ("id", "name", "path")]
    return nodes.withColumn("field", F.when(hit[0], "id").when(hit[1], "name").when(hit[2], "path")).where("field is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of rows of old with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
