"""Best-fit packing of token sequences under several capacities at once.

Every piece uses three capacities of a sequence: tokens, documents and attention cost (the sum of squared lengths). Pieces
are packed from the longest to the shortest; each goes to the open sequence whose residual capacities fit it best (least
weighted norm of what would be left, or largest weighted dot product of piece and residual) under every constraint.

Pieces of equal length are alike and sequences with equal residuals are alike, so the packing runs on counts: a histogram
of lengths (`max_tokens` rows at most, whatever the table's size) goes to the driver, which packs whole classes of
sequences at once; each piece then finds its place by its rank among the pieces of its length. Ranks are counted where
the pieces are made, so no group of equal lengths meets in one task.

Defined cases. Null text: empty. Empty text: the end token alone. Empty table: no rows. Repeated rows and null or repeated
ids: packed as often as they stand. A piece longer than max_tokens doesn't exist: longer documents are cut, whole, however
long. The result has the operator's columns only, so no name of the input can clash.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices, table

#: The same ids as byte_bpe_50k.json of the tokenizers library (tests compare them), from the same vocabulary as ranks.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json: the library emits its id wherever a text holds it, with or without add_special_tokens.
ADDED = {"<|endoftext|>": 50256}
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Byte-level BPE ids of texts as little-endian unsigned 32-bit values.

    The look-ahead of the pre-tokenizer's pattern only matters in runs of white space; texts without any take the pattern
    without it, which is matched several times as fast. Texts are split at the `added` tokens first, which keep their ids.
    """

    def __init__(self, path: str, added: dict[str, int]):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.full, self.plain = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added) for name, pattern in (("full", PATTERN), ("plain", PATTERN.replace(r"\s+(?!\S)|", "")))
        )
        self.run = re.compile(r"\s\s").search

    def of(self, text: str) -> bytes:
        ids = array("I", (self.full if self.run(text) else self.plain).encode(text, allowed_special="all", disallowed_special=()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_ids: dict[tuple, Ids] = {}


def cut_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `most` tokens but the first."""
    head = n % most or min(n, most)
    return [(0, head)] + [(s, most) for s in range(head, n, most)]


class Plan:
    """Packs a histogram {length: count}; `places` has (length, first rank, count, first sequence, offset) of each class placed at once."""

    def __init__(self, counts: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights=(1.0, 0.01, 0.01), rule: str = "norm"):
        self.caps, self.weights, self.rule = (max_tokens, max_docs, max_cost), weights, rule
        self.places: list[tuple[int, int, int, int, int]] = []
        self.n_sequences = 0
        self.open: dict[int, dict[tuple[int, int], list[tuple[int, int]]]] = defaultdict(dict)  # residual tokens: residual (docs, cost): [(first, count)]
        self.levels: list[int] = []
        for length in sorted(counts, reverse=True):
            self._pack(length, counts[length])

    def _put(self, level: int, rest: tuple[int, int], run: tuple[int, int]) -> None:
        if not level or not rest[0]:
            return
        if not self.open[level]:
            insort(self.levels, level)
        self.open[level].setdefault(rest, []).append(run)

    def _fit(self, level: int, rest: tuple[int, int], item: tuple[int, int, int]) -> float:
        left = (level, *rest)
        if self.rule == "dot":
            return -sum(w * (a / c) * (i / c) for w, a, i, c in zip(self.weights, left, item, self.caps, strict=True))
        return sum(w * ((a - i) / c) ** 2 for w, a, i, c in zip(self.weights, left, item, self.caps, strict=True))

    def _best(self, item: tuple[int, int, int]) -> tuple[int, tuple[int, int]] | None:
        best = None
        for level in self.levels[bisect_left(self.levels, item[0]) :]:
            # a looser level can't win on the norm once its tokens alone leave more than the best has in all
            if best and self.rule == "norm" and self.weights[0] * ((level - item[0]) / self.caps[0]) ** 2 >= best[0]:
                break
            for rest in self.open[level]:
                if rest[0] >= 1 and rest[1] >= item[2]:
                    fit = self._fit(level, rest, item)
                    if best is None or fit < best[0]:
                        best = (fit, level, rest)
        return best and best[1:]

    def _pack(self, length: int, count: int) -> None:
        item, rank = (length, 1, length * length), 0
        while rank < count:
            if found := self._best(item):
                level, rest = found
                runs = self.open[level][rest]
                first, n = runs.pop()
                if not runs:
                    del self.open[level][rest]
                if not self.open[level]:
                    self.levels.remove(level)
                use = min(n, count - rank)
                if use < n:
                    self._put(level, rest, (first + use, n - use))
            else:  # as many new sequences as the rest fills
                each = max(1, min(self.caps[0] // length, self.caps[1], self.caps[2] // item[2]))
                level, rest, first = self.caps[0], self.caps[1:], self.n_sequences
                use = max(1, (count - rank) // each)
                self.n_sequences += use
            self.places.append((length, rank, use, first, self.caps[0] - level))
            rank += use
            self._put(level - length, (rest[0] - 1, rest[1] - item[2]), (first, use))


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int, id_col: str, text_col: str, with_ids: bool, added: dict[str, int]) -> DataFrame:
    """A row for each piece, with `part` (the task that made it) and `nth` (its rank among the task's pieces of its length)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, *sorted(added.items()))
        if key not in _ids:
            _ids[key] = Ids(tokenizer, added)
        ids, part, seen = _ids[key], TaskContext.get().partitionId(), defaultdict(int)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids.of(text or "") + end
                for i, (start, n) in enumerate(cut_pieces(len(data) // 4, max_tokens)):
                    piece = data[4 * start : 4 * (start + n)]
                    rows.append((doc, i, start, n, zlib.crc32(piece), part, seen[n], *([piece] if with_ids else [])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids")
            columns = list(zip(*rows, strict=True)) or [[]] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)], names=list(names[: len(columns)]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(make, f"{_PIECE}, part int, nth long" + ", ids binary" * with_ids)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 2,
    max_tokens: int = 1024,
    max_docs: int = 1024,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    added: dict[str, int] | None = ADDED,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A text's "<|endoftext|>" is that token, as the tokenizers library has it by default; with `added` None it is text.
    The attention capacity is max_tokens squared unless given, which a full sequence of one document needs.
    """
    spark = docs.sparkSession
    max_cost = max_cost or max_tokens * max_tokens
    pieces = cut(pieces_of(docs, tokenizer or tokenizer_path(), end_id, max_tokens, id_col, text_col, with_ids, added or {}), "pack-pieces")
    made = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    plan = Plan(counts, max_tokens, max_docs, max_cost, weights, rule)
    steps = np.array(sorted(plan.places), dtype=np.int64).reshape(-1, 5)  # its size follows the number of lengths, not of rows
    shared = spark.sparkContext.broadcast(steps)
    ahead = made.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("ahead"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        keys = (steps[:, 0] << 44) + steps[:, 1]
        for batch in slices(batches):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            batch = batch.drop_columns(["rank"])
            yield batch.append_column("sequence_id", pa.array(steps[at, 3] + rank - steps[at, 1])).append_column("offset", pa.array(steps[at, 4]))

    ranked = pieces.join(ahead, ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return ranked.select(*kept, "rank").mapInArrow(place, _PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
