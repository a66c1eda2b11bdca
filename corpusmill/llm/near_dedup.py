"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct runs of k words (A-Z lower-cased). Two permutations make the signature: one scatters
the shingles over a circle, the other, shifted by 0, 1, 2, ... steps, gives all coordinates. Bands of coordinates bring
candidates together, and every link is confirmed on the full sets before it counts.

Equal sets become one class first, so copies never meet in a bucket. In each bucket all members are compared with the
bucket's centre, the member that meets others most often (linear in its size); links join components. Only members of
buckets that still hold several components are looked at again: buckets led by the same component are one crowd, and the
sets outside of its leading component are compared with all others of the crowd, exactly, in the task (tile by tile, if the
crowd is large or its sets are); what comes out is one link for each set and component. So a large group of copies comes
together around its centre and isn't expanded into its pairs, and no candidate pair that could join two components is left
out. A band, crowd, set or component that holds many rows is joined where its rows are (hot_join).

Defined cases. Null or blank text: empty set, linked with nothing, a component of its own. Fewer than k words: the whole
sequence is the one shingle. Repeated rows: one component. Null doc_id: takes part, but gives its component no id; a
component without any id has the id null. keep_one decides by row: of each component the first row with the smallest id
stays (without any id, one row), and repeats of that id and text with it. Very long texts: whole sets, tiles by their size.
Empty table: no rows. near_duplicates returns its own columns only, keep_one all of the input, whatever their names. At the
threshold 0.8 a pair is missed by all bands with probability (1 - 0.8**6)**42 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, cut, free_name, hot_join, release, slices, table
from .graph import components
from .kernels import band_keys, circulant, set_hash, shingles

#: Sets of a crowd that are compared at once, and bytes of them.
TILE, TILE_BYTES = 4096, 24 << 20


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(id_col, text_col)


def sketches(docs: DataFrame, k: int, n_hashes: int, rows: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_key, bands): the last two are null for empty sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = circulant(n_hashes, seed)
        for batch in slices(batches):
            texts = [(x or "").encode() for x in batch.column(2).to_pylist()]
            sizes, keys, bands = [], [], []
            for a, b in blocks_of(texts):
                for each in shingles(texts[a:b], k):
                    own = np.unique(each)
                    sizes.append(len(own))
                    keys.append(set_hash(own) if len(own) else None)
                    bands.append(band_keys(circle.signature(own), rows) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "n_shingles", "set_key", "bands"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return own.mapInArrow(make, "doc_id long, row_key long, n_shingles long, set_key long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of sets with 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = ([x.encode() for x in batch.column(c).to_pylist()] for c in ("text_u", "text_v"))
            keep = []
            for a, b in blocks_of(left):
                both = shingles([*left[a:b], *right[a:b]], k)
                known: dict[int, np.ndarray] = {}
                for i in range(b - a):
                    x, y = (known[h] if (h := hash(t)) in known else known.setdefault(h, np.unique(s)) for t, s in ((left[a + i], both[i]), (right[a + i], both[b - a + i])))
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("set_key").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("set_key").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v").mapInArrow(check, "u long, v long")


def set_table(texts: DataFrame, k: int) -> DataFrame:
    """(set_key, shingles): each text's set as sorted 64-bit hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [x.encode() for x in batch.column(1).to_pylist()]
            sets = [np.unique(x).tobytes() for a, b in blocks_of(data) for x in shingles(data[a:b], k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["set_key", "shingles"])

    return texts.select("set_key", "text").mapInArrow(make, "set_key long, shingles binary")


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """For each left set a mask of the right sets that it is linked with; by an inverted index of the right ones."""
    sizes = np.array([len(x) for x in right])
    values, which = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), sizes)[np.argsort(which, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(values)))])
    for own in left:
        i = np.minimum(np.searchsorted(values, own), len(values) - 1)
        i = i[values[i] == own]
        lists = [owner[at[j] : at[j + 1]] for j in i.tolist()]
        common = np.bincount(np.concatenate(lists), minlength=len(right)) if lists else np.zeros(len(right), dtype=np.int64)
        yield 100 * common >= percent * (len(own) + sizes - common)


def across(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components of a crowd: for each set outside of the crowd's leading component one link to each component that it has any with.

    crowded: (lead, set_key, comp, n: the set's size). A crowd of over TILE sets, or TILE_BYTES, is cut into tiles that are
    compared two by two.
    """
    counts = crowded.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("cuts"), F.count("*").alias("rows"))
    own = F.pmod(F.xxhash64("set_key"), F.col("cuts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct(F.least(own, i).alias("a"), F.greatest(own, i).alias("b")))
    dealt = hot_join(crowded.drop("n"), counts, ["lead"], "rows").join(sets, "set_key").select("lead", "comp", "set_key", "shingles", own.alias("own"), F.explode(tiles).alias("t"))
    dealt = dealt.select("lead", "comp", "set_key", "shingles", "own", "t.a", "t.b")

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lead, a, b = (x.as_py() for x in key)
        comp, keys, own = (rows.column(c).to_numpy() for c in ("comp", "set_key", "own"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
        us, vs = [], []
        # the leading component's sets needn't look for others: the others look for them
        for left, right in [(comp != lead, own == b)] if a == b else [((own == a) & (comp != lead), own == b), ((own == b) & (comp != lead), (own == a) & (comp == lead))]:
            x, y = np.flatnonzero(left), np.flatnonzero(right)
            if len(x) and len(y):
                for i, mask in zip(x.tolist(), linked([sets[i] for i in x], [sets[j] for j in y], percent), strict=True):
                    hit = y[mask & (comp[y] != comp[i])]
                    hit = hit[np.unique(comp[hit], return_index=True)[1]]
                    us += [keys[i]] * len(hit)
                    vs += keys[hit].tolist()
        del sets
        if rows.nbytes > 8 << 20:
            release()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return dealt.groupBy("lead", "a", "b").applyInArrow(compare, "u long, v long")


def grouped(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    n_hashes: int = 252,
    rows: int = 6,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(the sketches, and for each set: set_key, comp, rep: its smallest doc_id, first: its first row's key after that)."""
    sketch = cut(sketches(docs, k, n_hashes, rows, seed, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))  # rows with an id before others
    classes = cut(
        sketch.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key"), first.alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    members = classes.select("set_key", F.explode("bands").alias("band"))
    buckets = cut(members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.col("size")), "sizes")
    shared = cut(hot_join(members, buckets, ["band"], "n"), "buckets")
    # the text that copies were made from meets each of them in more buckets than they meet each other: the best centre
    degrees = shared.groupBy("set_key").agg(F.sum("size").alias("degree"))
    shared = cut(shared.join(degrees, "set_key"), "shared")
    hub = F.max_by("set_key", F.struct("degree", "set_key"))
    centres = cut(shared.groupBy("band").agg(hub.alias("centre"), F.count("*").alias("n")), "centres")
    sizes = classes.select("set_key", "n")

    def likely(pairs: DataFrame) -> DataFrame:
        """Without repeats and without pairs whose sizes alone rule them out."""
        x = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct()
        x = x.join(sizes.withColumnsRenamed({"set_key": "u", "n": "nu"}), "u").join(sizes.withColumnsRenamed({"set_key": "v", "n": "nv"}), "v")
        return x.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v")

    def texts_of(keys: DataFrame) -> DataFrame:
        """(set_key, text) of one document for each set."""
        wanted = keys.join(classes.select("set_key", "row_key"), "set_key")
        if wanted.count() <= broadcast_rows:  # 16 bytes each
            wanted = F.broadcast(wanted)
        texts = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).join(wanted, "row_key").select("set_key", "text")
        return texts.dropDuplicates(["set_key"])

    def links(pairs: DataFrame) -> DataFrame:
        pairs = cut(likely(pairs), "pairs")
        texts = texts_of(pairs.select(F.explode(F.array("u", "v")).alias("set_key")).distinct())
        return cut(verified(pairs, cut(texts, "texts"), k, percent), "links")

    found = links(hot_join(shared, centres, ["band"], "n").where("set_key != centre").select(F.col("centre").alias("u"), F.col("set_key").alias("v")))
    roots = components(found)
    placed = cut(shared.where("size > 2").join(roots, shared.set_key == roots.node, "left").select("band", "set_key", F.coalesce("root", "set_key").alias("comp")), "placed")
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("c"))
    mixed = cut(parts.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("lead"), F.count("*").alias("comps"), F.sum("c").alias("n")).where("comps > 1").select("band", "lead", "n"), "mixed")
    # buckets led by the same component are one crowd, in which each set stands once
    crowded = hot_join(placed, mixed, ["band"], "n").select("lead", "set_key", "comp").distinct()
    crowded = cut(crowded.join(sizes, "set_key"), "crowded")
    new = cut(across(crowded, set_table(texts_of(crowded.select("set_key").distinct()), k), percent), "links")
    if not new.isEmpty():
        roots = components(found.unionByName(new))
    return sketch, classes.join(roots, classes.set_key == roots.node, "left").select("set_key", "rep", "first", "copies", F.coalesce("root", "set_key").alias("comp"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, set_key."""
    sketch, named = grouped(docs, **how)
    named = cut(named, "named")
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    of_set = hot_join(named, ids, ["comp"], "n").select("set_key", "component_id", "copies")
    rows = sketch.select("doc_id", "n_shingles", "set_key")
    out = hot_join(rows.where("set_key is not null"), of_set, ["set_key"], "copies")
    out = out.unionByName(rows.where("set_key is null").withColumn("component_id", F.col("doc_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "n_shingles", "component_id", "kept", "set_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, by row and not by id: rows of empty sets, and rows that repeat the kept one's id and text, stay."""
    name = free_name(docs, "key")
    sketch, named = grouped(docs, id_col=id_col, text_col=text_col, **how)
    first = named.groupBy("comp").agg(F.min("first").alias("first")).select("first.row_key")
    filled = sketch.where("set_key is not null").select("doc_id", "row_key")
    gone = cut(filled.join(first, "row_key", "left_anti").select(F.col("row_key").alias(name)).distinct(), "gone")
    keyed = docs.withColumn(name, _row_key(id_col, text_col))
    kept = keyed.join(gone, name, "left_anti")
    # rows without an id that repeat each other are one row
    again = cut(filled.where("doc_id is null").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_key").alias(name)), "repeated")
    if not again.isEmpty():
        kept = kept.join(again, name, "left_anti").unionByName(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.drop(name)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: The same by plain means: every document's shingles, every pair that shares one, reachability.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), each AS (SELECT doc_id, md5_number(unnest(s)) AS h FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE r.root < e.v),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN c USING (doc_id)
"""
