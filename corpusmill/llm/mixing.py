"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts.

Each document gets a hash-random key of its id and text; within its source it stands in the order of the keys. The order is
cut into fine ranges of the key, so that a large source is spread over many tasks: sums of ranges are added up first, then
sums within each range. A source's budget takes whole epochs over all its documents and then the order's beginning, up to the
exact word where the budget ends.

Sums run over (source, key, number of copies): rows alike in source, id and text are one row there, so they weigh nothing
however many they are; each of them then stands in the order after the copies before it.

Defined cases. Null text: size 0, takes nothing. Null source: a source of its own, last in order. Null or repeated doc_id:
ordered by the text as well; rows alike in both are interchangeable. Very long texts: counted whole. Columns of the input with
the names of the added ones are dropped. Source without words: target 0. Empty table: no rows. The sources' totals go to the
driver: one row for each source, `max_sources` at most (an error beyond it).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, copies_apart, cut, free_name, hot_join, table

WEIGHTS = (5, 2, 1)
#: Copies that one task may number; rows with more copies are numbered where they are.
HOT = 10_000


def n_words(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> dict[str | None, Fraction]:
    """Shares share * total among the sources by weight (dealt in code-point order, null last); no target above cap * size.

    What a full source can't take is dealt again by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    open_ = {s: (weights[i % len(weights)], Fraction(cap) * n) for i, (s, n) in enumerate(order)}
    rest, out = Fraction(share) * sum(n for _, n in order), {}
    while open_:
        unit = rest / sum(w for w, _ in open_.values())
        full = {s: most for s, (w, most) in open_.items() if unit * w > most}
        if not full:
            return out | {s: unit * w for s, (w, _) in open_.items()}
        out |= full
        rest -= sum(full.values())
        for s in full:
            del open_[s]
    return out


def mix_to_weights(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 8,
    range_rows: int = 2048,
    max_sources: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with more columns: `size` (words), `source_size`, `target` and `taken` (words the mix takes, repeats counted).

    A text isn't needed after its words are counted: if the caller doesn't select it, Catalyst leaves it out of the shuffle.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "taken")
    skey, key, copy, mark, ahead, full, part = (free_name(docs, n) for n in ("skey", "key", "copy", "mark", "ahead", "full", "part"))
    sized = docs.withColumn("size", n_words(text_col)).withColumn(skey, F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))).withColumn(key, order_key(seed, id_col, text_col))
    own = cut(sized.groupBy(skey, key).agg(F.count("*").alias("copies"), F.max("size").alias("size")), "mix-keys")
    n_rows, most = own.agg(F.sum("copies"), F.max("copies")).first()
    n_fine = 1 << max(0, math.ceil(math.log2(max(1, (n_rows or 0) / range_rows))))
    # the key's first 28 bits, scaled to the number of ranges
    own = own.withColumn("fine", F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * n_fine / (1 << 28)).cast("int")).withColumn("words", F.col("size") * F.col("copies"))
    sums = cut(own.groupBy(skey, "fine").agg(F.sum("words").alias("words")), "mix-sums")
    totals = sums.groupBy(skey).agg(F.sum("words").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {(r[skey][1:] if r[skey][0] == "s" else None): r["n"] for r in totals}
    rows = []
    for s, t in targets(list(sizes.items()), weights, share, cap).items():
        n, budget = sizes[s], math.floor(t)
        epochs = budget // n if n else 0
        rows.append(("n" if s is None else f"s{s}", n, float(t), epochs, budget - epochs * n))
    each = spark.createDataFrame(rows, f"{skey} string, source_size long, target double, {full} long, {part} long")
    starts = sums.select(skey, "fine", (F.sum("words").over(Window.partitionBy(skey).orderBy("fine")) - F.col("words")).alias("before"))
    within = F.sum("words").over(Window.partitionBy(skey, "fine").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    # a range holds range_rows rows or so; keys are random, so none is much larger
    placed = own.withColumn("within", within).join(starts, [skey, "fine"]).select(skey, key, "copies", (F.col("before") + F.col("within")).alias(ahead))
    sized = copies_apart(sized.withColumn(mark, F.concat_ws("|", skey, key)), mark, copy, HOT).drop(mark) if (most or 0) > HOT else sized.withColumn(copy, F.lit(0).cast("long"))
    out = hot_join(sized, placed, [skey, key], "copies").join(F.broadcast(each), skey)
    if (most or 0) > 1:
        out = out.withColumn(copy, F.col(copy) + F.row_number().over(Window.partitionBy(skey, key, copy).orderBy("size")) - 1)
    begin = F.col(ahead) + F.col(copy) * F.col("size")
    cut_here = F.greatest(F.lit(0), F.least(F.col("size"), F.col(part) - begin))
    return out.withColumn("taken", F.col(full) * F.col("size") + cut_here).drop(skey, key, copy, ahead, full, part)


def order_key(seed: int, id_col: str, text_col: str):
    """The random place of a row: MD5 of the seed, the id and the text's MD5."""
    parts = F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def apply_mix(mixed: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mix itself: a document stands as often as it was taken whole, and once cut to its first words if it was taken in part."""
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    rest = taken - whole * size
    # possessive: the match runs in a loop, not by recursion, however many words there are
    head = F.expr(rf"regexp_substr({text_col}, concat(r'^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{', cast(_left as string), r'}}+'))")
    copies = mixed.withColumn("_left", rest).withColumn("_copy", F.explode(F.sequence(F.lit(0), whole))).where((F.col("_copy") < whole) | (F.col("_left") > 0))
    text = F.when(F.col("_copy") < whole, F.col(text_col)).otherwise(head)
    return copies.withColumn(text_col, text).select(*columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('8|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS key FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s GROUP BY source),
t AS (SELECT 0 AS step, list({'s': source, 'n': n, 'w': w}) AS open, 1.5 * sum(n) AS rest, CAST([] AS STRUCT(s VARCHAR, t DOUBLE)[]) AS done FROM n UNION ALL
 SELECT step + 1, list_filter(open, lambda x: rest * x.w / list_sum(list_transform(open, lambda y: y.w)) <= 2 * x.n), rest - 2 * coalesce(list_sum(list_transform(list_filter(open, lambda x: rest * x.w / list_sum(list_transform(open, lambda y: y.w)) > 2 * x.n), lambda x: x.n)), 0),
  done || CASE WHEN len(list_filter(open, lambda x: rest * x.w / list_sum(list_transform(open, lambda y: y.w)) > 2 * x.n)) = 0 THEN list_transform(open, lambda x: {'s': x.s, 't': CAST(rest * x.w / list_sum(list_transform(open, lambda y: y.w)) AS DOUBLE)})
   ELSE list_transform(list_filter(open, lambda x: rest * x.w / list_sum(list_transform(open, lambda y: y.w)) > 2 * x.n), lambda x: {'s': x.s, 't': CAST(2 * x.n AS DOUBLE)}) END
 FROM t WHERE len(open) > 0 AND len(done) < (SELECT count(*) FROM n)),
g AS (SELECT d.s AS source, d.t AS target FROM (SELECT unnest(done) AS d FROM t QUALIFY step = max(step) OVER ())),
a AS (SELECT s.*, n.n AS source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget, sum(size) OVER (PARTITION BY s.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS ahead FROM s JOIN n ON n.source IS NOT DISTINCT FROM s.source JOIN g ON g.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken FROM a
"""
