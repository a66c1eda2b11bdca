"""SimHash fingerprints of documents and of their edited texts; search within a Hamming radius by permuted block tables.

The terms are runs of five words, weighted by their count; every distinct term votes on each of 128 bits.

The order of documents (descending doc_id, round about; equal ids by a hash of the text) is cut into ranges, whose bounds are
taken from a sorted sample of the keys. Each range gets the next range's first document as well, so every task reads its range
in order and has each document's successor at hand: the texts are shuffled once and no task sees more than a stream of its
own range. Rows alike in id and text that would fill a range are one row there: all but the last of them follow each other.

Near fingerprints: the bits are cut into four blocks; of two fingerprints at most three bits apart one block agrees, so four
tables, each with another block in front, bring them together. Equal fingerprints are one class before. Fingerprints that
share a block are compared tile by tile in the task, and what leaves a task is a count and a class for each of them, not the
pairs; a pair that meets in several tables counts in the first. Classes are joined to components.

Defined cases. Null text: empty. Text without words: all bits 0. Fewer than five words: the whole sequence is the one term.
Null doc_id: after all others, ordered by a hash of the text. Very long texts: whole, one at a time. A single document is its
own successor. Empty table: no rows. The result has the operator's columns only, so no name of the input can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import numbered
from .common import blocks_of, cut, hot_join, slices, small, table
from .graph import components
from .kernels import shingles, simhash

WORDS = 5
BITS = 128


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints_of(texts: list[str]) -> list[bytes]:
    out, data = [], [x.encode() for x in texts]
    for a, b in blocks_of(data):
        out += [simhash(x) for x in shingles(data[a:b], WORDS)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


#: The last place in the order: what has no id.
_NONE = -(1 << 63)


def _bounds(keys: DataFrame, rows: int, range_rows: int, most: int = 1 << 20, over: int = 8) -> np.ndarray:
    """Bounds (i, h) between the ranges, ascending: every `over`-th row of a sorted sample of the keys, `most` bounds at most (16 bytes each)."""
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / range_rows))
    n = min(n, most)
    every = max(1, rows // (n * over))
    sample = keys.where(F.pmod(F.xxhash64("i", "h"), F.lit(every)) == 0).distinct()
    step = over if every > 1 else max(1, math.ceil(rows / n))
    found = numbered(sample, ["i", "h"]).where(F.col("n") % step == 0).select("i", "h").collect()  # n of them
    return np.array(sorted((r["i"], r["h"]) for r in found), dtype=np.int64).reshape(-1, 2)


def _range_of(bounds: np.ndarray):
    """An expression of i and h: how many bounds are at most (i, h). Only the two numbers go to Python, in Arrow batches."""

    @F.pandas_udf("int")
    def place(i, h):
        x, y = i.to_numpy(), h.to_numpy()
        at = np.searchsorted(bounds[:, 0], x, side="right")
        first = np.searchsorted(bounds[:, 0], x, side="left")
        for k in np.flatnonzero(first < at):  # an id that is a bound itself, maybe several times: the hash decides
            at[k] = first[k] + np.searchsorted(bounds[first[k] : at[k], 1], y[k], side="right")
        return type(i)(at.astype(np.int32))

    return place(F.col("i"), F.col("h"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 2000, hot_rows: int = 10_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    placed = docs.withColumn("h", F.xxhash64("text")).withColumn("i", F.coalesce("doc_id", F.lit(_NONE)))
    keys = cut(placed.groupBy("i", "h").agg(F.count("*").alias("n")), "keys")
    rows, most = keys.agg(F.sum("n"), F.max("n")).first()
    rows = rows or 0
    again = None
    if (most or 0) > hot_rows:
        hot = cut(keys.where(F.col("n") > hot_rows), "hot")  # rows / hot_rows of them at most
        alike = cut(placed.join(F.broadcast(hot), ["i", "h"]).groupBy("i", "h", "n").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")), "alike")
        again = alike.select("doc_id", "text", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("copy")).drop("copy")
        placed = placed.join(F.broadcast(hot.select("i", "h")), ["i", "h"], "left_anti").unionByName(alike.select("doc_id", "text", "h", "i"))
    bounds = _bounds(keys.select("i", "h"), rows, range_rows)
    part = _range_of(bounds)
    heads = keys.withColumn("part", part).groupBy("part").agg(F.max(F.struct("i", "h")).alias("top")).orderBy(F.desc("part")).collect()  # a row for each range
    ends = [(b["part"], b["top"]["h"], b["top"]["i"], a["part"]) for a, b in zip(heads, heads[1:] + heads[:1], strict=True)]
    ends = spark.createDataFrame(ends, "part int, h long, i long, goal int")
    marked = placed.withColumn("part", part).join(F.broadcast(ends), ["part", "h", "i"], "left")
    # of rows alike in id and text each is a head; any of them serves, so the first that comes is taken
    copies = F.array_compact(F.array(F.struct("part", F.lit(0).alias("extra")), F.when(F.col("goal").isNotNull(), F.struct(F.col("goal").alias("part"), F.lit(1).alias("extra")))))
    dealt = marked.select("doc_id", "text", "h", "i", F.explode(copies).alias("c")).select("c.part", "c.extra", "doc_id", "i", "h", "text")
    dealt = dealt.repartition("part").sortWithinPartitions(F.desc("part"), "extra", F.desc("i"), F.desc("h"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that still waits for its successor: (part, doc_id, text, fingerprint)
        for batch in slices(batches):
            parts, extras, ids, texts = (batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text"))
            prints = fingerprints_of(texts)
            out, new = [], []
            for row in zip(parts, extras, ids, texts, prints, strict=True):
                if last and last[0] == row[0]:
                    new.append(edited(last[2], row[3]))
                    out.append((last, row))
                last = None if row[1] else (row[0], row[2], row[2 + 1], row[4])
            marks = fingerprints_of(new)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[1] for a, _ in out], pa.int64()),
                    "n_chars": pa.array([len(a[2]) for a, _ in out], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                    "fingerprint": pa.array([a[3].hex() for a, _ in out], pa.string()),
                    "edited_fingerprint": pa.array([m.hex() for m in marks], pa.string()),
                    "near_edited": pa.array([likeness(a[3], m) for (a, _), m in zip(out, marks, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(a[3], b[4]) for a, b in out], pa.float64()),
                    "next_id": pa.array([b[2] for _, b in out], pa.int64()),
                }
            )

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long"
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose successor is alike."""
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            prints, new = fingerprints_of(texts), [edited(t, t) for t in texts]
            marks = fingerprints_of(new)
            columns = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), pa.array([p.hex() for p in prints], pa.string())]
            columns += [pa.array([m.hex() for m in marks], pa.string()), pa.array([likeness(p, m) for p, m in zip(prints, marks, strict=True)], pa.float64()), pa.array([1.0] * len(texts), pa.float64()), ids]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in kinds.split(", ")])

    out = dealt.mapInArrow(make, kinds)
    return out if again is None else out.unionByName(again.mapInArrow(follow, kinds))


#: Fingerprints that are compared at once.
TILE = 2048


def _words(prints: pa.Array) -> np.ndarray:
    """Fingerprints (hex) as rows of two 64-bit words."""
    raw = bytes.fromhex("".join(prints.to_pylist()))
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, BITS // 64)


def _labels(near: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric matrix of links, by the smallest row in it."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_prints(prints: DataFrame, radius: int = 3, print_col: str = "fingerprint") -> DataFrame:
    """(fingerprint, n_near, node, root) of the different fingerprints (hex): how many others are at most `radius` bits away, and their component.

    node is a hash of the fingerprint, root the smallest node that can be reached over near ones (its own, if it has none).
    """
    blocks, digits = radius + 1, BITS // 4
    at = [round(i * digits / blocks) for i in range(blocks + 1)]
    each = cut(prints.select(F.col(print_col).alias("p")).where("p is not null").distinct().withColumn("node", F.xxhash64("p")), "prints")
    tables = F.array(*(F.struct(F.lit(n).alias("t"), F.substring("p", at[n] + 1, at[n + 1] - at[n]).alias("key")) for n in range(blocks)))
    keyed = each.select("p", "node", F.explode(tables).alias("x")).select("p", "node", F.xxhash64("x.t", "x.key").alias("key"), "x.t")
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "block-sizes")
    shared = hot_join(keyed, sizes, ["key"], "n")
    # small groups are put together to tasks of about a tile; large ones are cut into tiles that are compared two by two
    cuts = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), cuts).cast("int")
    n_units = max(1, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / TILE))
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.struct(F.least(own, i).alias("a"), F.greatest(own, i).alias("b")))
    dealt = shared.withColumn("own", own).withColumn("pair", F.explode(pairs))
    unit = F.when(F.col("size") > TILE, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(n_units)))
    dealt = dealt.select(unit.alias("unit"), (F.col("size") > TILE).alias("large"), "pair.a", "pair.b", "own", "key", "t", "p", "node")
    starts, ends = [4 * x for x in at[:-1]], [4 * x for x in at[1:]]

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = key[2].as_py(), key[3].as_py()
        rows = rows.sort_by([("key", "ascending"), ("node", "ascending")])
        group, node, t, own = (rows.column(c).to_numpy() for c in ("key", "node", "t", "own"))
        words = _words(rows.column("p").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1) if len(words) else np.zeros((0, BITS), np.uint8)
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
        out: list[list[np.ndarray]] = [[], [], []]
        for first, last in zip(edge[:-1].tolist(), edge[1:].tolist()):
            w, own_, names, table_ = words[first:last], own[first:last], node[first:last], int(t[first])
            near = sum(np.bitwise_count(w[:, None, j] ^ w[None, :, j]).astype(np.int16) for j in range(w.shape[1])) <= radius
            np.fill_diagonal(near, False)
            if a != b:  # rows of one tile meet in their own unit
                near &= own_[:, None] != own_[None, :]
            if not near.any():
                continue
            # a pair whose earlier blocks agree too has been counted there
            earlier = np.zeros_like(near)
            for n in range(table_):
                part = np.packbits(bits[first:last, starts[n] : ends[n]], axis=1)
                _, same = np.unique(part, axis=0, return_inverse=True)
                earlier |= same.reshape(-1)[:, None] == same.reshape(-1)[None, :]
            out[0].append(names)
            out[1].append(names[_labels(near)])
            out[2].append((near & ~earlier).sum(axis=1))
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({"u": columns[0], "v": columns[1], "n": columns[2]})

    met = cut(dealt.groupBy("unit", "large", "a", "b").applyInArrow(compare, "u long, v long, n long"), "near")
    counts = met.groupBy("u").agg(F.sum("n").alias("n_near"))
    roots = components(met.select("u", "v"))
    out = each.join(counts, F.col("node") == F.col("u"), "left").join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    return out.select(F.col("p").alias("fingerprint"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "node", F.coalesce("root", "node").alias("root"))


def with_near(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fingerprint_documents' rows with n_near and class_id: the smallest doc_id whose fingerprint can be reached over near ones."""
    prints = cut(prints, "fingerprints")
    near = cut(near_prints(prints.select("fingerprint"), radius), "near-prints")
    ids = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    of_print = cut(near.join(ids, "fingerprint"), "classes")
    classes = of_print.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    named = hot_join(of_print, classes, ["root"], "n").select("fingerprint", "n_near", "class_id", "copies")
    return hot_join(prints, named, ["fingerprint"], "copies")


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None, print_col: str = "fingerprint") -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints (hex) at most `radius` bits apart, with their distance: for small sets.

    A group of many near fingerprints is listed with all its pairs here; near_prints gives counts and classes instead. Equal fingerprints are one class beforehand, so copies don't multiply. The bits are cut into `blocks` blocks; of two
    fingerprints within the radius at least blocks - radius agree, so each choice of that many blocks, moved to the front,
    is a table whose key the two share.
    """
    blocks = blocks or radius + 2
    digits = BITS // 4
    at = [round(i * digits / blocks) for i in range(blocks + 1)]
    each = prints.select(F.col(print_col).alias("p")).where("p is not null").distinct()
    tables = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        front = F.concat(F.lit(f"{n}:"), *(F.substring("p", at[i] + 1, at[i + 1] - at[i]) for i in chosen))
        tables.append(front)
    keyed = each.select("p", F.explode(F.array(*tables)).alias("key"))
    halves = lambda c: [F.conv(F.substring(c, s, 8), 16, 10).cast("long") for s in range(1, digits, 8)]
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(halves("a"), halves("b"), strict=True)), F.lit(0))
    pairs = keyed.select(F.col("p").alias("a"), "key").join(keyed.select(F.col("p").alias("b"), "key"), "key").where("a < b")
    return pairs.select("a", "b", apart.alias("distance")).where(F.col("distance") <= radius).distinct()


def op9_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near(fingerprint_documents(table(spark, sf_dir, "documents"))).drop("next_id")
