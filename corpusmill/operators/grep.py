"""Search by regular expression in lines and blocks, with context, counts and limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..shared import joined_in_blocks


def line_table(docs: DataFrame, keep: list[str] = ["doc_id"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """A row for each line, numbered from 1."""
    return docs.select(*keep, F.posexplode(T.lines(F.col(text_col))).alias("i", "line")).select(*keep, (F.col("i") + 1).alias("line_no"), "line")


def pattern(p: str, case_sensitive: bool = False) -> str:
    """What a user typed as a Java pattern: literal if it doesn't compile, else any case (of all scripts) unless asked otherwise."""
    p = T.literal_pattern(p)
    return p if case_sensitive else f"(?iu){p}"


#: What can make a match in a line depend on what surrounds the line: anchors, boundaries, groups with a question mark, possessive loops.
_AROUND = re.compile(r"[\^$]|\\[AbBGRXzZ]|\(\?|[*+?}]\+")


def may_match(text: Column, p: str) -> Column:
    """False only for texts without a matching line; p as `pattern` returns it. Where the surroundings of a line count, whole texts tell nothing."""
    return F.lit(True) if _AROUND.search(p.removeprefix("(?iu)")) else text.rlike(p)


def grep_lines(docs: DataFrame, p: str, keep: list[str] = ["doc_id"], case_sensitive: bool = False) -> DataFrame:  # noqa: B006
    """Matching lines. Whole texts are tested first where that is safe, so only those with a match are cut into lines."""
    p = pattern(p, case_sensitive)
    return line_table(docs.where(may_match(F.col("text"), p)), keep).where(F.col("line").rlike(p))


def grep_blocks(blocks: DataFrame, p: str, types: list[str] | None = None, known_types: list[str] | None = None, source: str | None = None, source_col: str = "source") -> DataFrame:
    """Blocks whose content matches. Unknown types are ignored (all unknown: no type filter), and so is a source pattern that meets no source."""
    wanted = [t for t in types or [] if known_types is None or t in known_types]
    if wanted:
        blocks = blocks.where(F.col("block_type").isin(wanted))
    if source is not None:
        own = F.coalesce(F.col(source_col).rlike(pattern(source)), F.lit(False))
        if not blocks.where(own).limit(1).isEmpty():
            blocks = blocks.where(own)
    return blocks.where(F.col("content").rlike(pattern(p)))


def with_context(docs: DataFrame, p: str, k: int) -> DataFrame:
    """doc_id, line_no, line, is_match, gap_before for all lines within k of a match; gap_before marks where lines are left out."""
    p = pattern(p)
    lines = line_table(docs.where(may_match(F.col("text"), p))).withColumn("is_match", F.col("line").rlike(p))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    near = lines.withColumn("near", F.max("is_match").over(w.rowsBetween(-k, k))).where("near")
    return near.select("doc_id", "line_no", "line", "is_match", F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > 1, F.lit(False)).alias("gap_before"))


def context_size(matches: Column, n_lines: Column, most_lines: int = 150, most_k: int = 200) -> Column:
    """The largest k up to most_k for which the lines within k of the matches, and a marker in each gap, are most_lines at most; 0 if none.

    The search ends at the first k from 2 on that shows as many lines as k - 1 did: the size then no longer grows, which is
    when k - 1 shows every line, or all but one line in each gap, where the marker stands.
    """
    gaps = F.transform(F.sequence(F.lit(2), F.size(matches)), lambda i: F.element_at(matches, i) - F.element_at(matches, i - 1))
    gaps = F.when(F.size(matches) > 1, gaps).otherwise(F.array().cast("array<int>"))
    first, last = F.element_at(matches, 1), F.element_at(matches, -1)

    def total(k: Column) -> Column:
        inner = F.aggregate(gaps, F.lit(0), lambda s, g: s + F.least(g, 2 * k + 1) + F.when(g > 2 * k + 1, 1).otherwise(0))
        return F.least(first - 1, k) + 1 + inner + F.least(n_lines - last, k)

    within = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most_k)), lambda k: total(k) <= most_lines)), F.lit(0))
    whole = F.greatest(F.lit(1), first - 1, n_lines - last, F.coalesce(F.array_max(F.transform(gaps, lambda g: F.ceil((g - 2) / 2).cast("int"))), F.lit(1)))
    return F.when(n_lines <= most_lines, F.least(whole + 1, F.lit(most_k))).otherwise(within).cast("int")


def find_scripts(paths: DataFrame, targets: DataFrame, path_col: str = "path") -> DataFrame:
    """paths x targets where the target, as a pattern in any case, is in the path. targets (a caller's list): `target`."""
    return joined_in_blocks(paths, targets, F.expr(f"{path_col} rlike concat('(?iu)', trim(target))"))


def suffix_matches(paths: DataFrame, targets: DataFrame, path_col: str = "path") -> DataFrame:
    """paths x targets where, without extensions, either is the other's end."""
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    p, q = bare(path_col), bare("target")
    return joined_in_blocks(paths, targets, F.endswith(p, q) | F.endswith(q, p))


#: What a path looks like: with a slash, or with an extension at its end.
_PATH = re.compile(r"/|\.[A-Za-z0-9]{1,5}$")


def path_search(scripts: DataFrame, target: str) -> DataFrame:
    """(doc_id, line_no, verb, resolved): lines that refer to a path, constants filled in, backslashes dropped.

    A verb with a quoted path comes before any other literal of its line; a line counts once. Targets that don't look like
    a path find nothing here: they are for the plain search.
    """
    from .scripts import constants, resolved

    if not _PATH.search(target):
        return scripts.select("doc_id", F.lit(0).alias("line_no"), F.lit("").alias("verb"), F.lit("").alias("resolved")).where("false")
    p = pattern(target.replace("\\.", ".").replace("\\", "").strip().lstrip("/"))
    lines = line_table(scripts.withColumn("consts", constants(F.col("text"))), ["doc_id", "consts"]).where(F.contains("line", F.lit('"')))
    clean = lambda c: F.replace(resolved(c, F.col("consts"), unknown="erase"), F.lit("\\"), F.lit(""))
    said = r'(?i)\b(read|write|import)\s*:?\s*"([^"]*)"'
    x = lines.withColumn("verb", F.lower(F.regexp_extract("line", said, 1))).withColumn("by_verb", clean(F.regexp_extract("line", said, 2)))
    x = x.withColumn("literals", F.transform(F.regexp_extract_all("line", F.lit('"([^"]*)"'), F.lit(1)), clean))
    hit = (F.col("verb") != "") & F.col("by_verb").rlike(p)
    other = F.get(F.filter("literals", lambda t: t.rlike(p)), F.lit(0))
    return x.select("doc_id", "line_no", F.when(hit, F.col("verb")).otherwise("literal").alias("verb"), F.when(hit, F.col("by_verb")).otherwise(other).alias("resolved")).where("resolved is not null")


def grep_resolved(blocks: DataFrame, p: str, consts: Column) -> DataFrame:
    """Blocks whose content matches after its constants are filled in, for patterns that look like a path; others are matched as they are."""
    from .scripts import resolved

    text = resolved(F.col("content"), consts, unknown="erase") if _PATH.search(T.literal_pattern(p)) else F.col("content")
    return blocks.where(text.rlike(pattern(p)))


def route(question: Column) -> Column:
    """Which tool a question goes to, with confidence and the pattern to search for."""
    path = F.nullif(F.regexp_extract(question, r"(/[\p{L}\p{N}_./-]+)", 1), F.lit(""))
    camel = F.nullif(F.regexp_extract(question, r"\b([A-Z][a-z]+[A-Z][A-Za-z]*)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(question, r'"([^"]+)"', 1), F.lit(""))
    word = F.lower(question).rlike(r"(^|[^a-z])(find|list|where|which files|occurrences)([^a-z]|$)")
    tool = F.when(path.isNotNull() | word, "grep").otherwise("semantic")
    score = F.when(path.isNotNull(), 0.95).when(word, 0.85).otherwise(0.8)
    return F.struct(tool.alias("tool"), score.alias("confidence"), F.coalesce(path, camel, quoted).alias("pattern"))
