"""Sources and sinks: script folders, path mappings, question sets, indexes, graphs, reports, logs. All paths go through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut, delete, exists


def read_scripts(spark: SparkSession, *folders: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(file_id, file, text): a row for each file; the id is the name without extension. Folders that aren't there are skipped.

    A file that isn't UTF-8 has no text (null), so it gives no blocks. Files that several folders lead to count once.
    """
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "file_id string, file string, text string")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    x = reader.load(there).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))
    return x.dropDuplicates(["file"]).select(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "").alias("file_id"), "file", "text")


def decoded(content: Column) -> Column:
    """Bytes as text; null where they aren't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def write_scripts(scripts: DataFrame, folder: str) -> None:
    """One text file for each row of (doc_id, text), in a folder of its own."""
    scripts.select("text", F.col("doc_id")).write.partitionBy("doc_id").option("lineSep", "\0").mode("overwrite").text(folder)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path) from lines `id,path`; the first comma parts them, blank lines and lines without one are skipped."""
    return mapping_lines(spark.read.text(path)).drop("line_no")


def mapping_lines(lines: DataFrame) -> DataFrame:
    """(file_id, path, line_no) of lines `value`; line_no rises in the order of the file."""
    parts = F.split("value", ",", 2)
    return lines.withColumn("line_no", F.monotonically_increasing_id()).where("value like '%,%'").select(F.trim(parts[0]).alias("file_id"), F.trim(parts[1]).alias("path"), "line_no")


def inverse_mapping(mapping: DataFrame, order: str = "line_no") -> DataFrame:
    """path to id; of a path with several ids the last one in the given order."""
    return mapping.groupBy("path").agg(F.max_by("file_id", order).alias("file_id"))


#: What stands at the head of a script that names its own path.
HEADER = "///ORIGINAL_PATH: "


def logical_paths(scripts: DataFrame, mapping: DataFrame, unknown: str | None = None) -> DataFrame:
    """scripts (file_id, file, text) with `path`: the mapping's, else that of the first line, else the file's own (or `unknown`)."""
    first = F.split(F.coalesce("text", F.lit("")), "\n", 2)[0]
    header = F.when(F.startswith(first, F.lit(HEADER)), F.trim(F.expr(f"substring(split(coalesce(text, ''), '\n', 2)[0], {len(HEADER) + 1})")))
    m = mapping.select("file_id", F.col("path").alias("_mapped")).dropDuplicates(["file_id"])
    last = F.lit(unknown) if unknown is not None else F.col("file")
    return scripts.join(m, "file_id", "left").withColumn("path", F.coalesce("_mapped", header, last)).drop("_mapped")


def script_text(scripts: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_id, text) of the scripts asked for; what isn't there, or can't be read, gives an error text."""
    missing = F.concat(F.lit("Error: cannot read "), "file_id")
    return asked.select("file_id").join(scripts.select("file_id", "text"), "file_id", "left").select("file_id", F.coalesce("text", missing).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, answers, deterministic) of the answered questions of a set; answers newline-joined, numbers as text."""
    kind = "answered array<struct<question: string, deterministic: boolean, answers: array<string>>>"
    q = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("answered").alias("q"))
    return q.select("q.question", F.array_join("q.answers", "\n").alias("answers"), F.coalesce("q.deterministic", F.lit(False)).alias("deterministic"))


def read_judgements(spark: SparkSession, path: str, one_list: bool = True) -> DataFrame:
    """(question, llm_answer, reference, score) of a calibration set: files of one JSON list each, or of a JSON object in each line."""
    return spark.read.schema("question string, llm_answer string, reference string, score int").json(path, multiLine=one_list)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(index, summary) of JSON objects index -> summary, ordered by number; what is empty or can't be read gives no rows."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return x.select(F.explode("m").alias("k", "summary")).select(F.expr("try_cast(k as int)").alias("index"), "summary").where("index is not null").orderBy("index")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def resume(rows: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame:
    """Appends work(rows) to the table at `path`, in batches that are each written whole; rows that it holds already are left out."""
    spark = rows.sparkSession
    for i in range(batches):
        todo = rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
        if exists(spark, path):
            todo = pending(todo, spark.read.parquet(path), key)
        work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def save_index(vectors: DataFrame, path: str, kind: str = "full") -> None:
    """Rows by kind of index, so that reading one kind touches its files only."""
    vectors.withColumn("index_type", F.lit(kind)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_type").parquet(path)


def load_index(spark: SparkSession, path: str, kind: str = "full") -> DataFrame:
    return spark.read.parquet(path).where(F.col("index_type") == kind).drop("index_type")


def save_store(vectors: DataFrame, chunks: DataFrame, path: str, **about: str) -> None:
    """An index as three tables: vectors, chunks, and one row about both."""
    vectors.write.mode("overwrite").parquet(f"{path}/index")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    size = vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))
    size.join(chunks.agg(F.count("*").alias("chunks"))).select("*", *(F.lit(v).alias(k) for k, v in about.items())).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, vectors, chunks); an error names the first of them that is missing."""
    for part in ("metadata", "index", "chunks"):
        if not exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"no {part} at {path}")
    metadata, vectors, chunks = (spark.read.parquet(f"{path}/{part}") for part in ("metadata", "index", "chunks"))
    return metadata, vectors, chunks


def upsert(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows written over those with the same keys at `path`; of several new rows with a key any one stays."""
    spark, new = rows.sparkSession, rows.dropDuplicates(keys)
    if exists(spark, path):
        new = spark.read.parquet(path).join(new.select(*keys), keys, "left_anti").unionByName(new)
    cut(new, "upsert").write.mode("overwrite").parquet(path)  # the old files are read to the end before they go
    return spark.read.parquet(path)


def hybrid_upsert(dense: DataFrame, sparse: DataFrame, payload: DataFrame, path: str, key: str = "doc_id") -> dict[str, DataFrame]:
    """Three tables by chunk: a vector, its terms (key, term, weight), and what is shown of it. Terms of a chunk are replaced as a whole."""
    spark = dense.sparkSession
    if exists(spark, f"{path}/sparse"):
        kept = spark.read.parquet(f"{path}/sparse").join(dense.select(key).distinct(), key, "left_anti")
        sparse = kept.unionByName(sparse)
    cut(sparse, "sparse").write.mode("overwrite").parquet(f"{path}/sparse")
    return {"dense": upsert(dense, f"{path}/dense", [key]), "sparse": spark.read.parquet(f"{path}/sparse"), "payload": upsert(payload, f"{path}/payload", [key])}


def clear(spark: SparkSession, path: str) -> bool:
    """Drops an index; False if there was none."""
    return delete(spark, path) if exists(spark, path) else False


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, built and written first if it isn't there."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, source_files: int) -> None:
    """Nodes and edges, and one row of JSON about them: counts by type."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph_counts(nodes, edges).withColumn("source_files", F.lit(source_files)).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_count, edge_count, nodes_by_type, edges_by_type), maps of a few types."""
    by = lambda df, n: df.groupBy("type").agg(F.count("*").alias("c")).agg(F.sum("c").alias(f"{n}_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "c")))).alias(f"{n}s_by_type"))
    return by(nodes, "node").join(by(edges, "edge"))


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); an error tells to build the graph first if it isn't there."""
    if not exists(spark, f"{path}/nodes"):
        raise FileNotFoundError(f"no graph at {path}: build and save it first")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_results(grades: DataFrame, path: str, models: dict[str, str], tokens: tuple[int, int] | None = None, partial: bool = False) -> str:
    """A benchmark's grades as JSON rows beside one row about the run; interrupted runs are kept apart by their name. Returns where."""
    at = path + ("_partial" if partial else "")
    spark = grades.sparkSession
    grades.write.mode("overwrite").json(f"{at}/results")
    about = spark.range(1).select(F.create_map(*(F.lit(x) for kv in models.items() for x in kv)).alias("models"), *([F.struct(F.lit(tokens[0]).alias("in"), F.lit(tokens[1]).alias("out")).alias("tokens")] if tokens else []))
    about.coalesce(1).write.mode("overwrite").json(f"{at}/about")
    return at


def save_statistics(stats: DataFrame, path: str) -> None:
    """Tool statistics (tool, calls, seconds) as one JSON object of maps."""
    maps = stats.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "calls")))).alias("tool_call_counts"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "seconds")))).alias("tool_execution_times"))  # a few tools
    maps.coalesce(1).write.mode("overwrite").json(path)


def save_session(steps: DataFrame, path: str) -> None:
    """A session's steps (session_id, step, ...) as JSON rows by session."""
    steps.write.mode("overwrite").partitionBy("session_id").json(path)


def load_session(spark: SparkSession, path: str, session_id: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, session_id string").json(path).where(F.col("session_id") == session_id)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert of all writes in order. Rows meet as partial maxima, not as a sorted group."""
    named = F.struct(*order, *(c for c in rows.columns if c not in order)).alias("_row")
    return rows.select(*keys, named).groupBy(*keys).agg(F.max("_row").alias("_row")).select(*(F.col("_row")[c].alias(c) for c in rows.columns))


def first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: what is written once stays."""
    named = F.struct(*order, *(c for c in rows.columns if c not in order)).alias("_row")
    return rows.select(*keys, named).groupBy(*keys).agg(F.min("_row").alias("_row")).select(*(F.col("_row")[c].alias(c) for c in rows.columns))


def tail(log: DataFrame, n: int, order: str) -> DataFrame:
    """The last n entries of a log."""
    return log.orderBy(F.desc(order)).limit(n)


def kth_last(log: DataFrame, k: int, order: str) -> DataFrame:
    """The k-th entry from the end (1: the last); none if the log is shorter."""
    return tail(log, k, order).withColumn("_n", F.row_number().over(Window.orderBy(F.desc(order)))).where(F.col("_n") == k).drop("_n")


def format_of(df: DataFrame) -> str:
    """Which kind of report a JSON file holds, by its fields."""
    names = set(df.schema.fieldNames())
    return "statistics" if "tool_call_counts" in names else "benchmark" if {"results", "models"} & names or "score" in names else "unknown"


#: Kinds of blocks as they are written and what else they may be called.
BLOCK_TYPES = ("section_header", "form_read", "import", "read", "write", "const", "export", "table", "show", "filter", "comment", "assignment", "unknown")


def to_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON object."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("json"))


def from_json(rows: DataFrame, key: str, schema: str, type_col: str = "block_type") -> DataFrame:
    """The rows again. A block's type may be given by its name in any case; another one is an error."""
    x = rows.select(key, F.from_json("json", schema).alias("r")).select(key, "r.*")
    known = F.lower(F.col(type_col))
    return x.withColumn(type_col, F.when(known.isin(*BLOCK_TYPES), known).otherwise(F.raise_error(F.concat(F.lit("no such type: "), F.coalesce(type_col, F.lit("null"))))))


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Both sides' rows by place; an error if there aren't as many on either side."""
    from ..shared import numbered

    if left.count() != right.count():
        raise ValueError("both sides must have the same number of rows")
    return numbered(left, [order], "_place").join(numbered(right.withColumnRenamed(order, f"{order}_right"), [f"{order}_right"], "_place"), "_place").drop("_place")
