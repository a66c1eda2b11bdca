"""What is read and written: script folders, mappings, question sets, indexes, graphs, reports, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import scripts as S
from ..registry import query
from ..shared import scratch
from .graph import EDGES, edges
from .inputs import BLOCKS, DUCK, scripts, table


@query("mapping_roundtrip", f"WITH scripts AS ({DUCK}) SELECT CAST(doc_id AS VARCHAR) AS file_id, path || ',v1' AS path FROM scripts")
def mapping_roundtrip(spark, d):
    """Written as lines `id,path` and read again; only the first comma parts them."""
    at = scratch(spark, "mapping")
    scripts(spark, d).select(F.concat_ws(",", F.col("doc_id").cast("string"), "path", F.lit("v1"))).write.text(at)
    return sources.read_mapping(spark, at)


@query("inverse_mapping", "SELECT source AS path, CAST(max(doc_id) AS VARCHAR) AS file_id FROM documents GROUP BY source")
def inverse_mapping(spark, d):
    return sources.inverse_mapping(table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("path")), "doc_id")


@query("qa_explode", "SELECT 'q' || CAST(item_id AS VARCHAR) AS question, CAST(item_id AS VARCHAR) || chr(10) || text AS answers, item_id % 2 = 0 AS deterministic FROM benchmark")
def qa_explode(spark, d):
    """A question set as JSON, with answers of text and numbers, read as rows."""
    at = scratch(spark, "questions")
    b = table(spark, d, "benchmark")
    one = F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), (F.col("item_id") % 2 == 0).alias("deterministic"), F.array(F.col("item_id").cast("string"), "text").alias("answers"))
    b.repartition(F.col("item_id")).select(F.array(one).alias("answered")).write.option("maxRecordsPerFile", 1).json(at)  # a file is one set
    return sources.read_questions(spark, at)


@query("script_scan", f"WITH scripts AS ({DUCK}) SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM scripts")
def script_scan(spark, d):
    """Scripts written as files, a folder each, and read again whole; a folder that isn't there is skipped."""
    at = scratch(spark, "scripts")
    sources.write_scripts(scripts(spark, d), at)
    found = sources.read_scripts(spark, at, f"{at}/none", glob="*.txt", recursive=True)
    return found.select(F.regexp_extract("file", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), F.regexp_replace("text", "\0$", "").alias("text"))


@query("broken_files", f"WITH RECURSIVE {BLOCKS} SELECT s.doc_id, CASE WHEN s.doc_id % 3 = 0 THEN 0 ELSE (SELECT count(*) FROM blocks b WHERE b.doc_id = s.doc_id) END AS blocks FROM scripts s")
def broken_files(spark, d):
    """Files that aren't UTF-8 give no blocks, and no error."""
    s = scripts(spark, d)
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xff\xfe")))).otherwise(F.col("text").cast("binary"))
    read = s.select("doc_id", sources.decoded(content).alias("text"))
    counts = S.parse_scripts(read).groupBy("doc_id").agg(F.count("*").alias("blocks"))
    return s.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("logical_paths", f"WITH scripts AS ({DUCK}) SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN '/head/' || n_name ELSE '/files/' || CAST(doc_id AS VARCHAR) END AS path, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN '/head/' || n_name ELSE 'Unknown Path' END AS known FROM scripts")
def logical_paths(spark, d):
    """A script's path: by the mapping, by its first line, else the file's own or a fixed word."""
    s = scripts(spark, d)
    m = F.col("doc_id") % 3
    files = s.select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("/files/"), F.col("doc_id").cast("string")).alias("file"), F.when(m == 1, F.concat(F.lit("///ORIGINAL_PATH: /head/"), "n_name", F.lit(" \n"), "text")).otherwise(F.col("text")).alias("text"))
    mapping = s.where(m == 0).select(F.col("doc_id").cast("string").alias("file_id"), "path")
    known = sources.logical_paths(files, mapping, "Unknown Path").select("file_id", F.col("path").alias("known"))
    return sources.logical_paths(files, mapping).select("file_id", "path").join(known, "file_id")


@query("script_text", f"WITH scripts AS ({DUCK}) SELECT 'f' || CAST(i AS VARCHAR) AS file_id, coalesce((SELECT text FROM scripts WHERE doc_id = i), 'Error: cannot read f' || CAST(i AS VARCHAR)) AS text FROM range(0, 2000, 5) r(i)")
def script_text(spark, d):
    """Whole scripts by id; an error text for those that aren't there."""
    s = scripts(spark, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), "text")
    return sources.script_text(s, spark.range(0, 2000, 5).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_id")))


@query("summary_cache", "SELECT CAST(doc_id AS INTEGER) AS index, lang || ' ' || source AS summary FROM documents WHERE doc_id % 7 = 0")
def summary_cache(spark, d):
    """A cache of JSON objects; one that can't be read, an empty one and keys that are no numbers are skipped."""
    at = scratch(spark, "summaries")
    docs = table(spark, d, "documents").where("doc_id % 7 = 0")
    rows = docs.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), F.concat_ws(" ", "lang", "source"))).alias("value"))
    more = spark.createDataFrame([("{broken",), ("{}",), ('{"x": "no number"}',)], "value string")
    rows.unionByName(more).repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(at)
    return sources.read_summaries(spark, at)


@query("index_roundtrip", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'full' ELSE 'summary' END AS kind, label, count(*) AS n FROM embeddings GROUP BY ALL")
def index_roundtrip(spark, d):
    """Two kinds of index saved one after the other; each is read by itself."""
    at, e = scratch(spark, "index"), table(spark, d, "embeddings")
    sources.save_index(e.where("vec_id % 2 = 0"), at, "full")
    sources.save_index(e.where("vec_id % 2 = 1"), at, "summary")
    each = [sources.load_index(spark, at, kind).groupBy(F.lit(kind).alias("kind"), "label").agg(F.count("*").alias("n")) for kind in ("full", "summary")]
    return each[0].unionByName(each[1])


@query("store_roundtrip", "SELECT (SELECT count(*) FROM embeddings) AS vectors, 64 AS dims, (SELECT count(*) FROM documents) AS chunks, 'flat' AS index_type, (SELECT count(*) FROM embeddings JOIN documents ON doc_id = vec_id) AS joined")
def store_roundtrip(spark, d):
    """Vectors, chunks and what is known of them, saved and loaded."""
    at = scratch(spark, "store")
    sources.save_store(table(spark, d, "embeddings"), table(spark, d, "documents"), at, index_type="flat")
    about, vectors, chunks = sources.load_store(spark, at)
    return about.join(vectors.join(chunks, vectors["vec_id"] == chunks["doc_id"]).agg(F.count("*").alias("joined")))


@query("upsert_latest", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return sources.latest(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("upsert_written", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def upsert_written(spark, d):
    """Rows written over a table's rows with the same ids."""
    at, e = scratch(spark, "upsert"), table(spark, d, "embeddings").select("vec_id", "label")
    sources.upsert(e.where("vec_id % 2 = 0"), at, ["vec_id"])
    return sources.upsert(e.where("vec_id % 3 = 0").withColumn("label", F.lit(-1)), at, ["vec_id"])


@query(
    "hybrid_upsert",
    r"WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN 'new words ' || lang ELSE text END), '[\p{L}\p{N}_]+'))) AS term FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0), n AS (SELECT doc_id, count(*) AS terms FROM t GROUP BY doc_id) "
    "SELECT doc_id, coalesce(terms, 0) AS terms, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents LEFT JOIN n USING (doc_id) WHERE doc_id % 3 = 0 OR doc_id % 2 = 0",
)
def hybrid_upsert(spark, d):
    """Vectors, terms and payload of chunks, some of them written again with other texts."""
    at, docs = scratch(spark, "hybrid"), table(spark, d, "documents")

    def write(rows, version):
        return sources.hybrid_upsert(rows.select("doc_id", F.array(F.lit(1.0)).alias("embedding")), R.term_weights(rows), rows.select("doc_id", F.col("source").alias("path"), F.lit(version).alias("version")), at)

    write(docs.where("doc_id % 2 = 0"), 1)
    out = write(docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new words "), "lang")), 2)
    terms = out["sparse"].groupBy("doc_id").agg(F.count("*").alias("terms"))
    return out["payload"].join(out["dense"], "doc_id").join(terms, "doc_id", "left").select("doc_id", F.coalesce("terms", F.lit(0)).alias("terms"), "version")


@query("clear_index", "SELECT true AS cleared, false AS again, count(*) AS rebuilt FROM embeddings")
def clear_index(spark, d):
    """An index dropped (once), and built again because it isn't there."""
    at, e = scratch(spark, "cleared"), table(spark, d, "embeddings")
    sources.load_or_build(spark, at, lambda: e.limit(1))
    cleared, again = sources.clear(spark, at), sources.clear(spark, at)
    rebuilt = sources.load_or_build(spark, at, lambda: e)
    return rebuilt.agg(F.count("*").alias("rebuilt")).select(F.lit(cleared).alias("cleared"), F.lit(again).alias("again"), "rebuilt")


@query("block_index", f"WITH RECURSIVE {BLOCKS} SELECT block_type, count(*) AS n FROM blocks GROUP BY block_type")
def block_index(spark, d):
    """Parsed blocks, built once; the second call reads them."""
    at = scratch(spark, "blocks")
    sources.load_or_build(spark, at, lambda: S.parse_scripts(scripts(spark, d)))
    return sources.load_or_build(spark, at, lambda: 1 / 0).groupBy("block_type").agg(F.count("*").alias("n"))


@query("graph_roundtrip", f"WITH {EDGES}, n AS (SELECT DISTINCT dst, CASE WHEN type = 'imports' THEN 'script' ELSE 'data_file' END AS type FROM edges) SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM n WHERE type = 'script') AS scripts, (SELECT count(*) FROM edges WHERE type = 'reads') AS reads, (SELECT count(*) FROM scripts) AS source_files")
def graph_roundtrip(spark, d):
    """A graph and what is counted of it, saved and loaded."""
    at, e = scratch(spark, "graph"), edges(spark, d)
    sources.save_graph(G.nodes_of(e), e, at, scripts(spark, d).count())
    nodes, again = sources.load_graph(spark, at)
    about = spark.read.json(f"{at}/metadata").select("source_files")
    return sources.graph_counts(nodes, again).join(about).select("node_count", "edge_count", F.col("nodes_by_type")["script"].alias("scripts"), F.col("edges_by_type")["reads"].alias("reads"), F.col("source_files").cast("long").alias("source_files"))


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    return sources.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("resume_appends", "SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM documents")
def resume_appends(spark, d):
    """A job that had done a third of the rows goes on with the others and never repeats any."""
    at, docs = scratch(spark, "resume"), table(spark, d, "documents")
    work = lambda run: lambda x: x.select("doc_id", F.length("text").cast("long").alias("n"), F.lit(run).alias("run"))
    sources.resume(docs.where("doc_id % 3 = 0"), at, "doc_id", work(1))
    return sources.resume(docs, at, "doc_id", work(2), batches=2)


@query("summary_progress", "SELECT (SELECT count(*) FROM labels) AS done, count(*) AS total FROM documents")
def summary_progress(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("total")).join(table(spark, d, "labels").agg(F.count("*").alias("done")))


@query("report_formats", "SELECT * FROM (VALUES ('benchmark', 40), ('statistics', 5), ('unknown', 5)) t(format, rows)")
def report_formats(spark, d):
    """Reports written and told apart by what they hold."""
    at = scratch(spark, "reports")
    grades = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 2).alias("score"))
    results = spark.read.json(f"{sources.save_results(grades, f'{at}/run', {'solver': 'none'}, (1, 2), partial=True)}/results")
    sources.save_statistics(E.tool_stats(table(spark, d, "events")), f"{at}/stats")
    stats = spark.read.json(f"{at}/stats")
    other = table(spark, d, "region")
    tools = stats.select(F.size(F.array_compact(F.array("tool_call_counts.*"))).alias("n")).first()["n"]
    rows = [(sources.format_of(results), results.limit(40).count()), (sources.format_of(stats), tools), (sources.format_of(other), other.count())]
    return spark.createDataFrame(rows, "format string, rows int")


@query("session_roundtrip", "SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3")
def session_roundtrip(spark, d):
    """Sessions saved by id; one is read back, by its own files."""
    at = scratch(spark, "sessions")
    sources.save_session(table(spark, d, "conversations").withColumn("session_id", F.concat(F.lit("s"), F.col("conv_id").cast("string"))), at)
    return sources.load_session(spark, at, "s3", "conv_id long, turn long, role string, text string").select("conv_id", "turn", "text")


@query("history_tail", "SELECT event_id, place FROM (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id DESC) AS INTEGER) AS place FROM events) WHERE place <= 5 UNION ALL SELECT event_id, -7 FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS place FROM events) WHERE place = 7")
def history_tail(spark, d):
    """The last five entries of a log of JSON lines, and the seventh from the end."""
    at = scratch(spark, "history")
    table(spark, d, "events").select("event_id", "event_type").write.json(at)
    log = spark.read.schema("event_id long, event_type string").json(at)
    last = R.ranked(sources.tail(log, 5, "event_id").withColumn("q", F.lit(1)), F.desc("event_id"), ["q"], [], name="place").select("event_id", "place")
    return last.unionByName(sources.kth_last(log, 7, "event_id").select("event_id", F.lit(-7).alias("place")))


@query("blocks_as_json", f"WITH RECURSIVE {BLOCKS} SELECT doc_id, block_type, name, line_start, line_end, definitions FROM (SELECT doc_id, block_type, name, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, definitions FROM blocks)")
def blocks_as_json(spark, d):
    """Blocks to JSON and back, their types in capitals on the way."""
    b = S.parse_scripts(scripts(spark, d)).withColumn("block_type", F.upper("block_type"))
    return sources.from_json(sources.to_json(b, "doc_id"), "doc_id", "block_type string, name string, line_start int, line_end int, definitions array<string>")


@query("zip_by_place", "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 2 = 1) SELECT a.vec_id, b.vec_id AS vec_id_right FROM a JOIN b USING (n)")
def zip_by_place(spark, d):
    """Two sides without a common key, row by row."""
    e = table(spark, d, "embeddings").select("vec_id")
    return sources.zipped(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id")


@query("file_paths", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN '/m/' || CAST(d.doc_id AS VARCHAR) END AS path FROM documents d")
def file_paths(spark, d):
    """File ids to logical paths; ids that the mapping lacks have none."""
    docs = table(spark, d, "documents")
    mapping = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("/m/"), F.col("doc_id").cast("string")).alias("path"))
    return docs.select("doc_id").join(mapping, "doc_id", "left")
