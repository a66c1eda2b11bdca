"""Blocks to chunks under a token bound: greedy packing with overlap, splits of what is too large, metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def pack(blocks: list[tuple[int, bool, int, bool]], most: int, overlap: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(first, last, tokens, from, overlap tokens) of greedy chunks over (tokens, is header, lines, overlaps already).

    A header begins a chunk, and so does a block that doesn't fit. Then the end of the chunk before is repeated: blocks up to
    `overlap` lines and three blocks, none of more than a fifth of `most`, as far as they leave room for the block; not after
    a header, nor before a part that overlaps already. `from` is the first repeated block (or `first`).
    """
    out, start, size, again, low = [], 0, 0, 0, 0
    for i, (n, header, _, joined) in enumerate(blocks):
        if i > start and (header or size + n > most):
            out.append((start, i - 1, size, low, again))
            back, lines, room, again = 0, 0, n, 0
            if not header and not blocks[i - 1][1] and not joined:
                while back < 3 and lines < overlap and i - 1 - back >= low:
                    m, _, own, _ = blocks[i - 1 - back]
                    if m > most // 5 or room + m >= most:
                        break
                    back, lines, room, again = back + 1, lines + own, room + m, again + m
            start, low, size = i, i - back, again
        size += n
    if blocks:
        out.append((start, len(blocks) - 1, size, low, again))
    return out


def pack_blocks(blocks: list[tuple[int, bool]], most: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """(first, last, tokens, repeated tokens) of greedy chunks over (tokens, is header), a line each; see `pack`."""
    return [(a, b, size, again) for a, b, size, _, again in pack([(n, h, 1, False) for n, h in blocks], most, overlap)]


def split_lines(sizes: list[int], most: int, overlap: int, share: float = 0.7, least: float = 0.4) -> list[tuple[int, int]]:
    """Ranges of lines (end exclusive) of share * most tokens; each begins with the last `overlap` lines of the one before.

    The last range is filled up from the lines before it to `least` * most, as far as `most` allows.
    """
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > share * most:
            if i > start:
                out.append((start, i))
            start = max(start, i - overlap)
            total = sum(sizes[start:i])
        total += n
    while sizes and total < least * most and start > 0 and total + sizes[start - 1] <= most:
        start -= 1
        total += sizes[start]
    return [*out, (start, len(sizes))] if sizes else out


def split_block(block: dict, most: int, overlap: int, chars_per_token: int = 3) -> list[dict]:
    """A block, or its parts if it has more than `most` tokens, each with what it names of the block's dependencies and definitions."""
    if len(block["content"]) // chars_per_token <= most:
        return [{**block, "part": 0, "parts": 0, "joined": False}]
    lines = re.findall(r"[^\n]*\n|[^\n]+$", block["content"])
    ranges = split_lines([len(x) // chars_per_token for x in lines], most, overlap)
    out = []
    for n, (a, b) in enumerate(ranges):
        content = "".join(lines[a:b])
        named = lambda words, text=content: [w for w in words if re.search(rf"\b{re.escape(w)}\b", text)]
        part = {"content": content, "line_start": block["line_start"] + a, "line_end": block["line_start"] + b - 1, "dependencies": named(block["dependencies"]), "definitions": named(block["definitions"])}
        out.append({**block, **part, "part": n + 1, "parts": len(ranges), "joined": n > 0})
    return out


SCRIPT_CHUNKS = (
    "doc_id long, chunk_no int, section string, block_types array<string>, line_start int, line_end int, tokens long, own_from int, overlap_blocks int, overlap_with int, split_part int, "
    "content string, dependencies array<string>, definitions array<string>, external array<string>, oversize boolean"
)


def chunk_blocks(blocks: list[dict], most: int = 512, overlap: int = 2, chars_per_token: int = 3) -> list[dict]:
    """Chunks of a script's blocks in order (fields of SCRIPT_CHUNKS but doc_id).

    `section` is the last header's name, `own_from` the first line that isn't repeated, `external` what a chunk depends on
    and doesn't define. A block that is too large in spite of the split (one long line) is a chunk with `oversize`.
    """
    parts = [p for b in blocks for p in split_block(b, most, overlap, chars_per_token)]
    measured = [(len(p["content"]) // chars_per_token, p["block_type"] == "section_header", p["content"].count("\n") + 1, p["joined"]) for p in parts]
    sections, section = [], None
    for p in parts:
        section = p["name"] if p["block_type"] == "section_header" else section
        sections.append(section)
    out = []
    for n, (first, last, tokens, low, _) in enumerate(pack(measured, most, overlap), 1):
        own = parts[low : last + 1]
        deps, defs = ({w for p in own for w in p[c]} for c in ("dependencies", "definitions"))
        out.append(
            {
                "chunk_no": n, "section": sections[first], "block_types": [p["block_type"] for p in own], "line_start": own[0]["line_start"], "line_end": own[-1]["line_end"], "tokens": tokens,
                "own_from": parts[first]["line_start"], "overlap_blocks": first - low, "overlap_with": n - 1 if first > low else None, "split_part": parts[first]["part"],
                "content": "\n".join(p["content"] for p in own), "dependencies": sorted(deps), "definitions": sorted(defs), "external": sorted(deps - defs), "oversize": tokens > most,
            }
        )
    return out


def chunk_scripts(scripts: DataFrame, most: int = 512, overlap: int = 2) -> DataFrame:
    """Scripts parsed and packed: a row for each chunk. Both read a script in order, so it is done in one pass, in Arrow batches."""
    from .scripts import parse_script

    names = [c.split()[0] for c in SCRIPT_CHUNKS.split(", ")]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, *(c[k] for k in names[1:])) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for c in chunk_blocks(parse_script(text or ""), most, overlap)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"overlap_with": "Int32"})

    return scripts.select("doc_id", "text").mapInPandas(make, SCRIPT_CHUNKS)


CHUNKS = "doc_id long, chunk_no int, first_block int, last_block int, tokens long, n_blocks int, overlap long, from_block int"


def chunk_lines(docs: DataFrame, most: int = 512, overlap: int = 0, chars_per_token: int = 3) -> DataFrame:
    """Greedy chunks of each text's non-blank lines (numbered from 1); lines without lower-case letters are headers.

    `overlap` counts repeated tokens, which begin at from_block.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                lines = [x for x in (text or "").split("\n") if x.strip(" ")]
                blocks = [(len(x) // chars_per_token, re.search(r"[a-z]", x) is None, 1, False) for x in lines]
                rows += [(doc, n, a + 1, b + 1, size, b - a + 1, again, low + 1) for n, (a, b, size, low, again) in enumerate(pack(blocks, most, overlap), 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(make, CHUNKS)


def generic_chunks(text: str, most: int, keep: int = 2, chars_per_token: int = 4) -> list[str]:
    """A text as it is if it fits, else in pieces of lines, each beginning with the last `keep` lines of the one before."""
    if len(text) // chars_per_token <= most:
        return [text]
    out, own = [], []
    for line in text.split("\n"):
        if own and len("\n".join([*own, line])) // chars_per_token > most:
            out.append("\n".join(own))
            own = own[-keep:] if keep else []
            while own and len("\n".join([*own, line])) // chars_per_token > most:
                own = own[1:]
        own.append(line)
    return [*out, "\n".join(own)]


def split_large(line: Column, most: int, share: float = 0.7) -> Column:
    """A text over `most` characters in pieces of share * most."""
    step = int(most * share)
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(line) - 1) / step)).cast("int")), lambda i: F.substring(line, i * step + 1, F.lit(step)))
    return F.when(F.length(line) > most, cuts).otherwise(F.array(line))


def providers(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, dependency, provider): for each dependency that a chunk doesn't define itself, the first chunk of the script that does (or null)."""
    needs = chunks.select("doc_id", "chunk_no", F.explode(F.array_except("dependencies", "definitions")).alias("dependency"))
    gives = chunks.select("doc_id", F.col("chunk_no").alias("provider"), F.explode("definitions").alias("dependency")).groupBy("doc_id", "dependency").agg(F.min("provider").alias("provider"))
    return needs.join(gives, ["doc_id", "dependency"], "left").select("doc_id", "chunk_no", "dependency", "provider")


def validate_chunks(chunks: DataFrame, most: int = 512) -> DataFrame:
    """(chunks, oversize, blank, valid): whether all chunks hold the bound and say something."""
    bad = F.count_if(F.col("tokens") > most), F.count_if(F.trim("content") == "")
    return chunks.agg(F.count("*").alias("chunks"), bad[0].alias("oversize"), bad[1].alias("blank"), ((bad[0] + bad[1]) == 0).alias("valid"))


def prepared(text: Column, most: int = 512, chars_per_token: int = 3) -> Column:
    """Without blank lines and trailing blanks; over `most` tokens, the share of lines that fits with a fifth to spare (one at least)."""
    kept = F.transform(F.filter(T.lines(text), lambda x: F.trim(x) != ""), lambda x: F.rtrim(x))
    whole = F.array_join(kept, "\n")
    n = T.token_estimate(whole, chars_per_token)
    some = F.greatest(F.lit(1), F.floor(F.size(kept) * F.lit(0.8) * most / n).cast("int"))
    return F.when(n > most, F.array_join(F.slice(kept, 1, some), "\n")).otherwise(whole)
