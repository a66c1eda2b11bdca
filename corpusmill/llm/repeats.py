"""Removal of byte strings of a given length that occur more than once in the collection, each document's windows in full.

A window is a run of `length` bytes; a byte goes if any window over it starts elsewhere too. Every window is represented by
its anchor, the leftmost k-gram with the least hash in it: equal windows have equal anchors at equal places. So the windows
fall into runs that share an anchor, and a run's context (the bytes that its windows cover) is compared as a whole first:

1. Each text gives (anchor, context, place) for its runs - about one for every (length - k) / 2 bytes.
2. Anchors that stand at one place only are done. Contexts that stand at several places are repeated in full.
3. Where an anchor has different contexts, the bytes of their windows are cut out of the texts, once. These pieces go through
   1 and 2 again with longer k-grams, and what is still open is compared window by window, by hashes.
4. Repeated windows become spans of their text, and the spans are cut out.

So the texts themselves meet other rows twice: for the pieces and for the spans. Tables that a step has used up are deleted.
All steps are counts, minima and joins with partial aggregation; an anchor, a context or a text that many rows share is
joined where its rows are (hot_join), so a passage or line in a third of all documents isn't gathered anywhere. Hashes are 64-bit polynomials of the bytes; see README for why the columns of a collection-wide suffix
order aren't built one after the other.

Defined cases. Null text: empty. Texts shorter than a window: nothing to remove. Exact copies: removed whole. Repeated
rows and null or repeated doc_ids: by their text like others. Very long texts: whole. Empty table: no rows. The result has
the operator's columns only, so no name of the input can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, cut, drop_cut, hot_join, slices, table
from .kernels import joined, mix, prefix_sums, span_hashes

U = np.uint64
_PLACE_BITS = 25


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least value of h[i : i + width] is, for every i; by minima from both sides of blocks of `width`."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(h) >> _PLACE_BITS:  # only for a single text of over 32 MB
        half = len(h) // 2
        return np.concatenate([sliding_argmin(h[: half + width - 1], width), sliding_argmin(h[half:], width) + half])
    low = U((1 << _PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U)
    full = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=U)
    full[: len(h)] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def runs_of_windows(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts, in runs with the same anchor: text number, first window's start, number of windows, anchor and context hashes."""
    buf, at = joined(texts)
    s = prefix_sums(buf)
    starts = np.arange(max(0, len(buf) - k + 1))
    anchor = sliding_argmin(span_hashes(s, starts, starts + k), length - k + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))[: len(anchor)]
    whole = np.arange(len(anchor)) + length < at[doc + 1]  # the window ends before the line feed after its text
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    edge = np.flatnonzero(np.concatenate([new | ~whole, [True]]))
    after = edge[np.searchsorted(edge, first, side="right")]
    count = after - first
    a = anchor[first]
    grams = span_hashes(s, a, a + k)
    contexts = mix(span_hashes(s, first, after - 1 + length) + (count.astype(U) << U(32)) + (a - first).astype(U))
    return doc[first], first - at[doc[first]], count, grams.view(np.int64), contexts.view(np.int64)


def window_hashes(text: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that start in the ranges (first, count)."""
    starts = np.unique(np.concatenate([np.arange(a, a + n) for a, n in ranges]))
    s = prefix_sums(np.frombuffer(text, dtype=np.uint8))
    return starts, span_hashes(s, starts, starts + length).view(np.int64)


def spans_of(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows starting in the ranges (first, count) cover."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(ranges):
        end = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same windows in ranges (first, count) that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(ranges):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - out[-1][0]))
        else:
            out.append((a, n))
    return out


RUNS = "tkey long, piece int, start int, n int, anchor long, context long"


def anchored(source: DataFrame, length: int, k: int) -> DataFrame:
    """RUNS of all pieces in source (tkey, piece: where it begins in its text, data), with `place`, a hash of text and start."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, shift = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data = batch.column(2).to_pylist()
            for a, b in blocks_of(data):
                doc, first, count, grams, contexts = runs_of_windows(data[a:b], length, k)
                arrays = [pa.array(x) for x in (keys[a + doc], shift[a + doc], (shift[a + doc] + first).astype(np.int32), count.astype(np.int32), grams, contexts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tkey", "piece", "start", "n", "anchor", "context"])

    return cut(source.select("tkey", "piece", "data").mapInArrow(anchors, RUNS), "anchors").withColumn("place", F.xxhash64("tkey", "start"))


def _ends() -> tuple:
    return F.min("place").alias("low"), F.max("place").alias("high")


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs whose windows all stand elsewhere too, runs whose windows have to be looked at more closely). Runs found once are done."""
    several = cut(rows.groupBy("anchor").agg(*_ends(), F.count("*").alias("rows")).where("low != high").select("anchor", "rows"), "several")
    shared = cut(hot_join(rows, several, ["anchor"], "rows", "left_semi"), "shared")
    contexts = cut(shared.groupBy("anchor", "context").agg(*_ends(), F.count("*").alias("rows")), "contexts")
    open_ = contexts.groupBy("anchor").agg(F.count("*").alias("all"), F.count_if(F.col("low") == F.col("high")).alias("single")).withColumn("open", (F.col("all") > 1) & (F.col("single") > 0)).select("anchor", "open", "all")
    open_ = cut(open_, "open")
    told = cut(hot_join(contexts, open_, ["anchor"], "all").where("low != high or open"), "told")
    out = cut(hot_join(shared, told, ["anchor", "context"], "rows").select("tkey", "piece", "start", "n", "low", "high", "place", "open"), "judged")
    drop_cut(rows, several, shared, contexts, open_, told)
    # of a repeated context one place stands for all
    return out.where("low != high").select("tkey", "start", "n"), out.where("open and (low = high or place = low)").select("tkey", "piece", "start", "n")


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of (tkey, piece, data, ranges) the bytes of the windows in the ranges, in runs that don't overlap."""
    for batch in slices(batches):
        keys, starts, out = [], [], []
        for key, piece, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("tkey", "piece", "data", "ranges")), strict=True):
            for a, n in merged_ranges([(r["start"], r["n"]) for r in ranges]):
                keys.append(key)
                starts.append(a)
                out.append(data[a - piece : a - piece + n - 1 + length])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(out, pa.binary())], names=["tkey", "piece", "data"])


def repeated_ranges(docs: DataFrame, copies: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """(tkey, start, n): n windows of the text with this key, from start on, stand elsewhere too. Exact copies don't count.

    docs: (tkey, data). copies: (tkey, c), how many rows have a text. Each length in grams is a level: what contexts at one
    level leave open goes to the next, whose longer anchors are rarer and whose contexts are shorter; what the last leaves
    open is compared window by window.
    """
    pieces_of = lambda x: x.mapInArrow(lambda batches: _cut_out(batches, length), "tkey long, piece int, data binary")
    whole = docs.where(F.octet_length("data") >= length).withColumn("piece", F.lit(0))
    wholes, source, last = [], whole, None
    for k in grams:
        repeated, left = judged(anchored(source, length, k))
        wholes.append(repeated)
        if last is None:
            ranges = left.groupBy("tkey").agg(F.collect_set(F.struct("start", "n")).alias("ranges")).join(copies.select("tkey", "c"), "tkey")
            met = hot_join(whole, cut(ranges, "left"), ["tkey"], "c")
            source = cut(pieces_of(met).dropDuplicates(["tkey", "piece"]), "pieces")
        else:
            ranges = left.groupBy("tkey", "piece").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
            source = cut(pieces_of(source.join(ranges, ["tkey", "piece"])), "pieces")
            drop_cut(last)
        last = source

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, piece, data in zip(*(batch.column(c).to_pylist() for c in ("tkey", "piece", "data")), strict=True):
                starts, hashes = window_hashes(data, [(0, len(data) - length + 1)], length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), key)), pa.array((starts + piece).astype(np.int32)), pa.array(hashes)], names=["tkey", "start", "window"])

    single = cut(source.mapInArrow(windows, "tkey long, start int, window long"), "windows").withColumn("place", F.xxhash64("tkey", "start"))
    again = cut(single.groupBy("window").agg(*_ends(), F.count("*").alias("rows")).where("low != high").select("window", "rows"), "again")
    out = hot_join(single, again, ["window"], "rows", "left_semi").select("tkey", "start", F.lit(1).alias("n"))
    for whole_ in wholes:
        out = out.unionByName(whole_)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, grams: tuple[int, ...] = (64, 150, 190), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end in bytes) and kept (the bytes that stay)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("data"))
    keyed = docs.withColumn("tkey", F.xxhash64("data"))
    copies = cut(keyed.where(F.octet_length("data") >= length).groupBy("tkey").agg(F.count("*").alias("c"), F.max(F.octet_length("data")).alias("bytes")), "copies")
    copied = copies.where("c > 1").select("tkey", F.lit(0).alias("start"), (F.col("bytes") - length + 1).alias("n"))
    ranges = repeated_ranges(keyed.select("tkey", "data"), copies, length, grams).unionByName(copied)
    of_text = ranges.groupBy("tkey").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[x for s in spans_of([(r["start"], r["n"]) for r in ranges], length) for x in s] for ranges in batch.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(spans, pa.list_(pa.int32()))], names=["tkey", "edges"])

    # a few numbers for each text, however many windows there were
    spans = cut(of_text.mapInArrow(merge, "tkey long, edges array<int>").join(copies.select("tkey", "c"), "tkey"), "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, data, inner in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                inner = inner or []
                edges = [0, *inner, len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(inner) // 2, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(inner[::2], inner[1::2], strict=True)], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    placed = hot_join(keyed, spans, ["tkey"], "c", "left").select("doc_id", "data", "edges")
    return placed.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans", "kept")


#: The same by plain means: every window of every text, those that stand twice, the runs of bytes that they cover.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i, 1, i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS ss, sum(b - a) AS gone, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT d.doc_id, d.h, coalesce(k.gone, 0) AS gone, coalesce(k.n, 0) AS n, coalesce(list_transform(k.ss, lambda x: x.a), []) || [length(d.h) // 2] AS ends, [0] || coalesce(list_transform(k.ss, lambda x: x.b), []) AS starts FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(array_to_string(list_transform(list_zip(starts, ends), lambda z: substr(h, CAST(2 * z[1] + 1 AS BIGINT), CAST(2 * (z[2] - z[1]) AS BIGINT))), ''))) AS kept_sha256 FROM o
"""
