"""Expressions on texts, lines and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def token_estimate(text: Column, chars_per_token: int = 3) -> Column:
    """Tokens as characters over a constant: what a counter without a vocabulary gives."""
    return F.floor(F.length(text) / chars_per_token).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def without_strings(text: Column) -> Column:
    """String literals (three quotes, double, single; escapes count) removed."""
    for pattern in (r'(?s)""".*?"""', r"(?s)'''.*?'''", r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"):
        text = F.regexp_replace(text, pattern, "")
    return text


def without_comments(text: Column) -> Column:
    """Block and line comments become one blank; string literals stay."""
    return F.regexp_replace(text, r'("(?:[^"\\\n]|\\.)*")|(?s:/\*.*?\*/)|//[^\n]*', "$1 ")


def normalized_path(path: Column) -> Column:
    """Slashes only, none doubled, bracketed numbers as a placeholder; a leading slash if it looks like a path."""
    p = F.regexp_replace(path, r"\[\s*\d+\s*\]", "[ X ]")
    p = F.regexp_replace(F.translate(p, "\\", "/"), "/{2,}", "/")
    return F.when(p.rlike(r"[/.]") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)


def execution_order(name: Column) -> Column:
    """The number that a name begins with: bracketed, or before a separator; null without one."""
    found = F.coalesce(F.nullif(F.regexp_extract(name, r"^\[\s*(\d+)", 1), F.lit("")), F.regexp_extract(name, r"^(\d+)[\s._\-]", 1))
    return F.nullif(found, F.lit("")).cast("int")


def glob_regex(glob: Column) -> Column:
    """A glob as an anchored pattern: * and ? are wild, all else is literal (brackets too)."""
    literal = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def ancestors(path: Column) -> Column:
    """/a/b/c -> [/a, /a/b, /a/b/c]."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalized_answer(text: Column) -> Column:
    """For comparing answers: no white space, lower case, word characters, slash, dash and dot only."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", "")), r"[^\p{L}\p{N}_/.\-]", "")


def evidence_id(content: Column, digits: int = 16) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(content, 256), 1, digits))


def literal_pattern(pattern: str) -> str:
    """A search pattern as given by a user: trimmed of blanks, quotes and slashes; what doesn't compile is taken literally."""
    import re

    p = pattern.strip().strip("\"'/").strip()
    try:
        re.compile(p)
    except re.error:
        return re.escape(p)
    return p
