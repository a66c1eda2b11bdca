"""Scripts of a line-oriented language: line types, typed blocks, constants, references, symbols, comment streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .chunks import chunk_lines, pack_blocks, prepared, providers, split_large  # noqa: F401 - one place for callers

#: In the order in which they are tried; the first that matches gives a line's type.
RULES = (
    ("blank", r"^\s*$"),
    ("section_header", r"^///\s*[~=\-]{3,}"),
    ("form_read", r"^\s*read\s+form\s"),
    ("import", r"^\s*import\s"),
    ("read", r"^\s*read\s"),
    ("write", r"^\s*write\s"),
    ("const", r"^\s*const\s"),
    ("export", r"^\s*export\s"),
    ("table", r"^\s*table\s"),
    ("show", r"^\s*show\s"),
    ("filter", r"^\s*(keep|where)\s"),
    ("comment", r"^//"),
    ("assignment", r"^\s*[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)?\s*="),
)
STARTERS = frozenset(t for t, _ in RULES) - {"blank"}
#: Words of the language, which never name a table or a variable.
BUILTINS = frozenset(
    """
    sum max min avg count distinct mode median
    date year month week day monday today
    abs round floor ceiling sqrt exp log pow
    concat replace substr strlen split
    cross extend range slice
    random uniform poisson normal
    if then else when where not and or all any assert
    by at into scan same default group order
    as with expect unsafe keep show upload form
    cumsum rankd rankrev sliceSearchUrl dashUrl downloadUrl
    text number boolean ranvar zedfunc
    rgb rgba
    """.split()
)
#: Columns that every table has.
PROPERTIES = frozenset("N Id date week month year day".split())


def line_type(line: Column) -> Column:
    out = F.lit("unknown")
    for name, p in reversed(RULES):
        out = F.when(line.rlike(p), name).otherwise(out)
    return out


def _type(line: str) -> str:
    return next((name for name, p in RULES if re.match(p, line)), "unknown")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


_STRINGS = re.compile(r'""".*?"""|\'\'\'.*?\'\'\'|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)
_QUALIFIED = re.compile(r"\b([A-Za-z0-9_]+)\.([A-Za-z_][A-Za-z0-9_]*)")
_CAPITAL = re.compile(r"\b[A-Z][A-Za-z0-9_]{2,}\b")
#: Where a capitalised word is no reference: in a comment, as a type, after `as`, as what a line defines.
_NO_REFERENCE = (re.compile(r"//[^\n]*"), re.compile(r":\s*[A-Z][A-Za-z0-9_]*\s*(?=,|\n|$)"), re.compile(r"\bas\s+[A-Z][A-Za-z0-9_]*\b"), re.compile(r"^\s*[A-Z][A-Za-z0-9_]*\s*=", re.M))
_IN_PATH = re.compile(r"\{(\w+)\}")
_IN_TEXT = re.compile(r"#\(([A-Za-z_]\w*)(?:\.\w+)?\)")


def names_table(word: str) -> bool:
    return len(word) > 1 and word.lower() not in BUILTINS and word not in PROPERTIES


def table_references(code: str) -> set[str]:
    """Tables that code refers to: what stands before a dot, and capitalised words that are neither fields nor defined, typed or commented there."""
    bare = _STRINGS.sub('""', code)
    pairs = _QUALIFIED.findall(bare)
    fields, rest = {f for _, f in pairs}, bare
    for pattern in _NO_REFERENCE:
        rest = pattern.sub("", rest)
    return {t for t, _ in pairs if names_table(t)} | {w for w in _CAPITAL.findall(rest) if w not in fields and names_table(w)}


def interpolations(code: str) -> set[str]:
    """Names in #(name) and #(name.member); words of the language and single letters aren't variables."""
    return {n for n in _IN_TEXT.findall(code) if len(n) > 1 and n.lower() not in BUILTINS}


def left_definitions(code: str) -> list[str]:
    """What the lines of a piece of code assign to, by its name before the dot; comments don't."""
    found = re.findall(r"^[ \t]*([A-Za-z_]\w*)(?:\.[A-Za-z_]\w*)?[ \t]*=", code, re.M)
    return sorted(set(found))


class Kind(NamedTuple):
    """How a type of block is read: where its name is, whether it defines it, and which part has tables, path variables and interpolations."""

    name: str | None = None
    defines: bool = False
    tables: str = ""
    paths: str = ""
    texts: str = ""
    own: bool = True  # whether it may depend on what it defines


KINDS = {
    "import": Kind(r"\sas\s+(\w+)", True),
    "read": Kind(r"\sas\s+([A-Za-z_]\w*)(?=\[|expect|\s|$)", True, paths="all"),
    "write": Kind(r"write\s+([A-Za-z_]\w*)", paths="all"),
    "const": Kind(r"const\s+([A-Za-z_]\w*)\s*=", True, "right", "right", "right"),
    "export": Kind(r"export\s+(?:const\s+)?(?:table\s+)?([A-Za-z_]\w*)", True, "right", texts="right", own=False),
    "table": Kind(r"table\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*=", True, "right", texts="right", own=False),
    "show": Kind(r'show\s+\w+\s+"([^"]+)"', tables="all", texts="all"),
    "filter": Kind(tables="all", texts="all"),
    "form_read": Kind(),
    "assignment": Kind(r"^\s*([A-Za-z0-9_]+)", True, "right", texts="right"),
    "unknown": Kind(),
}


def block_end(lines: list[str], start: int, kind: str) -> int:
    """The line after the last one of the block that begins at `start`.

    A header takes the comments right below it, a comment all comments up to another header or code (blank lines between
    them too). A statement ends before a line that starts another one, a header or a comment, no deeper than its first line;
    not while brackets or a triple quote are open or right after a backslash. Blank lines belong to it.
    """
    i = start + 1
    if kind == "section_header":
        while i < len(lines) and lines[i].startswith("//"):
            i += 1
        return i
    if kind == "comment":
        while i < len(lines) and _type(lines[i]) in ("comment", "blank"):
            i += 1
        return i
    base, depth, quote = _indent(lines[start]), 0, ""
    for i in range(start, len(lines) + 1):
        if i == len(lines):
            return i
        line = lines[i]
        if i > start and not depth and not quote and not lines[i - 1].rstrip().endswith("\\") and _indent(line) <= base and _type(line) in STARTERS:
            return i
        for mark in ('"""', "'''"):
            if quote in ("", mark) and line.count(mark) % 2:
                quote = "" if quote else mark
        bare = _STRINGS.sub("", line)
        depth = max(0, depth + sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}")))
    return i


def header_name(lines: list[str]) -> str | None:
    """The first text between separators on a header's lines."""
    for line in lines:
        if _type(line) == "section_header" and (words := re.sub(r"^///\s*[~=\-]+\s*|\s*[~=\-]*\s*/*\s*$", "", line).strip(" ~=-/\t")):
            return words
    return None


def read_block(kind: str, lines: list[str]) -> tuple[str | None, set[str], set[str]]:
    """(name, dependencies, definitions) of a block."""
    if kind == "section_header":
        return header_name(lines), set(), set()
    if kind == "comment":
        return None, set(), set()
    content, how = "\n".join(lines), KINDS[kind]
    name = (m := re.search(how.name, lines[0] if kind == "assignment" else content)) and m[1] if how.name else None
    part = {"all": content, "right": content.partition("=")[2], "": ""}
    refs = table_references(part[how.tables]) | set(_IN_PATH.findall(part[how.paths])) | interpolations(part[how.texts])
    defs = {name} if name and how.defines else set()
    if kind == "write" and name and names_table(name):
        refs.add(name)
    if kind == "import":
        items = re.split(r"\swith\s", content, maxsplit=1)[1:]
        defs |= {w for w in re.findall(r"^\s*([A-Za-z_]\w*)(?=\s|$)", "".join(items), re.M) if w not in BUILTINS}
    if kind == "form_read":
        defs = set(re.findall(r"^\s*(?!read\b)([A-Za-z_]\w*)\s*:\s*\w+", "\n".join(lines[1:]), re.M))
    if not how.own or (kind == "assignment" and not re.match(r"\s*\w+\.", lines[0])):
        refs -= defs
    return name, refs, defs


def parse_script(text: str) -> list[dict]:
    """Typed blocks with their lines (from 1, ends included), what they define and what they depend on."""
    lines, blocks, i = text.split("\n"), [], 0
    while i < len(lines):
        kind = _type(lines[i])
        if kind == "blank":
            i += 1
            continue
        end = block_end(lines, i, kind)
        own = [x for x in lines[i:end] if x.strip()] if kind == "comment" else lines[i:end]
        name, refs, defs = read_block(kind, own)
        blocks.append({"block_type": kind, "name": name, "line_start": i + 1, "line_end": end, "content": "\n".join(own), "dependencies": sorted(refs), "definitions": sorted(defs)})
        i = end
    return blocks


BLOCKS = "doc_id long, block_no int, block_type string, name string, line_start int, line_end int, content string, dependencies array<string>, definitions array<string>"


def parse_scripts(scripts: DataFrame) -> DataFrame:
    """Blocks of all scripts. Where a statement ends depends on the lines before, so each script is read in one piece, in Arrow batches."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for pdf in batches:
            rows = [(doc, n, *b.values()) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for n, b in enumerate(parse_script(text or ""), 1)]
            yield pd.DataFrame(rows, columns=names)

    return scripts.select("doc_id", "text").mapInPandas(parse, BLOCKS)


def validate_scripts(scripts: DataFrame) -> DataFrame:
    """(doc_id, valid, error): whether each script can be read; texts that can't (none at all, an unclosed bracket or quote) say why."""
    bare = T.without_comments(T.without_strings(F.coalesce("text", F.lit(""))))
    count = lambda marks: F.length(F.regexp_replace(bare, f"[^{marks}]", ""))
    error = F.when(F.col("text").isNull(), "no text").when(F.contains(bare, F.lit('"')), "open quote").when(count(r"(\[{") != count(r")\]}"), "brackets don't match")
    return scripts.select("doc_id", error.isNull().alias("valid"), error.alias("error"))


def section_of(lines: DataFrame, header: Column, name: Column) -> Column:
    """The last header's name up to each line."""
    return F.last(F.when(header, name), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def constants(text: Column) -> Column:
    """Map of constants to their (unresolved) values; the last of a name counts."""
    names = F.regexp_extract_all(text, F.lit(r'(?m)^\s*const\s+(\w+)\s*=\s*"([^"\n]*)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'(?m)^\s*const\s+(\w+)\s*=\s*"([^"\n]*)"'), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    lasts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(lasts)


_ASSIGNED = r'(?m)^[ \t]*(?:const[ \t]+)?(\w+)[ \t]*=[ \t]*"([^"\n]*)"'


def variables(scripts: DataFrame) -> DataFrame:
    """(doc_id, name, value, line_no, resolved): constants and variables that hold a string, read from top to bottom.

    A placeholder takes the value that its name has above; unknown ones stay. `resolved` tells whether one was replaced.
    """
    code = scripts.select("doc_id", T.without_comments(F.col("text")).alias("text"))
    lines = code.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).where(F.col("line").rlike(_ASSIGNED))
    found = lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("line", _ASSIGNED, 1).alias("name"), F.regexp_extract("line", _ASSIGNED, 2).alias("raw"))
    above = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    known = found.withColumn("before", F.collect_list(F.struct("name", "raw")).over(above))
    # what stands above is resolved from the nearest line upwards, as each value could only use those above it
    value = F.aggregate(F.reverse("before"), F.col("raw"), lambda s, p: F.replace(s, F.concat(F.lit("{"), p["name"], F.lit("}")), p["raw"]))
    return known.select("doc_id", "name", value.alias("value"), "line_no", (value != F.col("raw")).alias("resolved"))


def resolved(text: Column, consts: Column, passes: int = 11, unknown: str = "keep") -> Column:
    """Placeholders {name} replaced by their constants, at most `passes` deep; unknown ones are kept, or erased."""
    for _ in range(passes):
        text = F.aggregate(F.map_entries(consts), text, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return text if unknown == "keep" else F.regexp_replace(text, r"\{\w+\}", "")


#: What a script reads and writes (also from a form of show) and imports: edge type and pattern of the path.
_VERBS = (
    ("reads", r'(?m)^\s*read\b[^"\n]*"([^"\n]+)"'),
    ("writes", r'(?m)^\s*write\b[^"\n]*"([^"\n]+)"'),
    ("writes", r'(?m)^\s*show\b[^\n]*\bwrite\s*:\s*"([^"\n]+)"'),
    ("imports", r'(?m)^\s*import\b[^"\n]*"([^"\n]+)"'),
)


def references(scripts: DataFrame, passes: int = 4) -> DataFrame:
    """(doc_id, path, type, target) of every read, write and import; targets resolved and normalised, open placeholders as *."""

    def of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.lit(kind).alias("type"), t.alias("raw")))

    found = scripts.withColumn("consts", constants(F.col("text"))).select("doc_id", "path", "consts", F.explode(F.concat(*(of(k, p) for k, p in _VERBS))).alias("r"))
    target = T.normalized_path(F.regexp_replace(resolved(F.col("r.raw"), F.col("consts"), passes), r"\{\w*\}", "*"))
    return found.select("doc_id", "path", F.col("r.type").alias("type"), target.alias("target"))


#: Kinds of symbols and the patterns that find them.
SYMBOLS = (
    ("variables", r"(?m)^[ \t]*([A-Z][A-Za-z0-9_]*\.[A-Za-z0-9_]+)[ \t]*="),
    ("variables", r"\b(Is[A-Z][A-Za-z0-9_]+)\b"),
    ("functions", r"(?m)^[ \t]*(?:export[ \t]+)?def[ \t]+(?:(?:pure|process|nosort)[ \t]+)*([A-Za-z_][A-Za-z0-9_]*)"),
    ("variables", r"\bconst\s+([A-Za-z0-9_]+)\s*="),
    ("tables", r"""\bread\s+"[^"\n]*"(?:\s+unsafe)?\s+as\s+([A-Z][A-Za-z0-9_]+)"""),
)


def symbols(scripts: DataFrame) -> DataFrame:
    """(doc_id, kind, name, n): how often each symbol of five families stands in a script; what isn't met has no row."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    return scripts.select("doc_id", F.explode(F.concat(*(found(k, p) for k, p in SYMBOLS))).alias("s")).groupBy("doc_id", "s.kind", "s.name").agg(F.count("*").alias("n"))


#: Streams of comments by what a line begins with, longest first.
STREAMS = (("memos", "////"), ("structure", "///"), ("business", "//'"))


def doc_streams(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, stream, note): comment lines by their marks, and each closed block between triple quotes as one note of `user`.

    lines: (doc_id, line_no, line). Marks toggle, so a running count tells on which side of them a line is; lines inside
    keep their indentation and aren't comments. A block that is never closed has no note.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("s", F.trim("line")).withColumn("mark", F.startswith(F.col("s"), F.lit('"""')))
    marked = marked.withColumn("seen", F.count_if(F.col("mark")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("seen") % 2 == 1) | F.col("mark")
    stream = F.lit(None).cast("string")
    for name, mark in reversed(STREAMS):
        stream = F.when(F.startswith(F.col("s"), F.lit(mark)), name).otherwise(stream)
    size = {name: len(mark) for name, mark in STREAMS}
    note = F.coalesce(*(F.when(stream == n, F.trim(F.expr(f"substring(s, {k + 1})"))) for n, k in size.items()))
    plain = marked.where(~inside).select("doc_id", "line_no", stream.alias("stream"), note.alias("note")).where("stream is not null")
    block = F.floor((F.col("seen") + 1) / 2)
    part = F.struct("line_no", F.when(F.col("mark"), F.replace("s", F.lit('"""'), F.lit(""))).otherwise(F.col("line")).alias("t"))
    blocks = marked.where(inside).groupBy("doc_id", block.alias("block")).agg(F.min("line_no").alias("line_no"), F.count_if("mark").alias("marks"), F.sort_array(F.collect_list(part)).alias("parts"))
    user = blocks.where("marks = 2").select("doc_id", "line_no", F.lit("user").alias("stream"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("note"))
    return plain.unionByName(user)


def function_bodies(lines: DataFrame, pattern: str = r"^\s*(?:export\s+)?def\s+") -> DataFrame:
    """(doc_id, line_start, line_end): each line that matches, with the deeper lines below it; blank lines belong to the body.

    A body ends before the next line no deeper than its first; trailing blank lines are in it.
    """
    x = lines.withColumn("ind", F.when(F.trim("line") != "", T.indent(F.col("line")))).withColumn("head", F.col("line").rlike(pattern) & ~F.startswith(F.trim("line"), F.lit("//")))
    heads = x.where("head").select("doc_id", F.col("line_no").alias("line_start"), F.col("ind").alias("base"))
    last = x.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    stops = heads.join(x.where("ind is not null").select("doc_id", "line_no", "ind"), "doc_id").where((F.col("line_no") > F.col("line_start")) & (F.col("ind") <= F.col("base")))
    ends = stops.groupBy("doc_id", "line_start").agg((F.min("line_no") - 1).alias("stop"))
    return heads.join(ends, ["doc_id", "line_start"], "left").join(last, "doc_id").select("doc_id", "line_start", F.coalesce("stop", "last").alias("line_end"))


#: Classes of assignments, tried in this order, by what stands right of the sign.
CLASSES = (
    ("aggregation", r"\b(sum|avg|max|min|count|distinct|mode|median)\s*\("),
    ("conditional", r"\bif\b.*\bthen\b"),
    ("calculation", r"[-+*/]"),
    ("string", r'"'),
    ("date", r"\b(date|today|monday|week|month|year)\b"),
)


def assignment_class(right: Column) -> Column:
    out = F.lit("simple")
    for name, p in reversed(CLASSES):
        out = F.when(right.rlike(p), name).otherwise(out)
    return out


def legacy_sections(text: Column, least: int = 20) -> Column:
    """The parts of a script between delimiter lines of `least` or more separators, blank parts left out."""
    parts = F.transform(F.split(text, rf"(?m)^//+\s*[~=\-]{{{least},}}.*$"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")
