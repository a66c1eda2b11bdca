"""Personal data: fixed patterns, and terms that disclose the entities found, by corpus co-occurrence. DataFrame functions only.

The patterns find protected entities (e-mail and IP addresses, card and phone numbers). Terms that stand near an entity are
judged by what they tell about it: the pointwise mutual information of entity and term over all documents, against the
information that the entity itself carries. A term that gives away `alpha` of it or more is a disclosing term, however few
texts the entity stands in, and is a span too wherever it stands, with that entity or alone. For an entity of a single
text these are the terms that stand in N**(1 - alpha) of the N texts at most. Sanitising generalises each span to the name
of its kind (or removes disclosing terms).

Positions come from cutting the text at the matches and adding up lengths, all in code points. Counts are of different
texts, so that copies don't make evidence. Co-occurrence is looked for in the whole text, outside of the base spans. All
words are counted first; a term in more texts than any of the entity's pairs could pass with never becomes a pair, so pairs
grow with mentions and their rare words, never with pairs of words; a common term or entity only meets partial sums.

Defined cases. Null text: empty, no spans, and null after sanitising. Repeated rows: each the same. Null doc_id: as any
other. Empty table: no rows. Very long texts: the patterns run in loops, not by recursion, and start at the beginnings of
runs alone; running sums and pieces of a text go by blocks, so many matches take time in proportion. Columns of the input
named `email`, `ip`, `card`, `phone` or `term` are replaced, any other name is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table

_LOCAL = "[A-Za-z0-9._%+-]"
#: What the contract's patterns match, with possessive loops and without starts inside a run that must fail.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "instr({0}, '@') > 0", "ip": r"{0} rlike r'[0-9]\.[0-9]'", "card": r"{0} rlike r'[0-9](?:[\x20-]?[0-9]){{12}}'", "phone": "instr({0}, '+') > 0"}
_DIGITS = r"regexp_replace(x.value, r'[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({0})), 0L, (s, i) -> s + case when i % 2 = 1 then cast(substr(reverse({0}), i, 1) as int) "
    "else (2 * cast(substr(reverse({0}), i, 1) as int)) div 10 + (2 * cast(substr(reverse({0}), i, 1) as int)) % 10 end) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": r"forall(transform(split(x.value, r'\.'), p -> ltrim('0', p)), p -> length(p) < 3 or (length(p) = 3 and p <= '255'))",
    "card": f"(case when length({_DIGITS}) between 13 and 19 then {_LUHN.format(_DIGITS)} else false end)",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
#: A word: letters, marks and digits, three or more; also two, where the first is a capital or of a script without any.
TERM = r"[\p{L}\p{M}\p{N}]{3,}|(?<![\p{L}\p{M}\p{N}])[\p{Lu}\p{Lo}][\p{L}\p{M}](?![\p{L}\p{M}\p{N}])"


def let(value: str, name: str, body: str) -> str:
    """SQL of body, where `name` stands for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(a: str, op: str, at: str = "") -> str:
    """SQL of the running totals of an int array (a name) by an operation {0}, {1} from 0 on; in blocks of 64, so that long arrays take little more than linear time."""
    fold = lambda x: f"aggregate({x}, 0, (s, y) -> {op.format('s', 'y')})"
    sums = f"transform(sequence(0, cast(greatest(0, size({a}) - 1) div 64 as int)), b -> {fold(f'slice({a}, b * 64 + 1, 64)')})"
    heads = f"transform(sums{at}, (h, b) -> {fold(f'slice(sums{at}, 1, b)')})"
    inner = fold(f"slice({a}, cast(i div 64 as int) * 64 + 1, i % 64 + 1)")
    each = op.format(f"heads{at}[cast(i div 64 as int)]", inner)
    return let(sums, f"sums{at}", let(heads, f"heads{at}", f"transform({a}, (v, i) -> {each})"))


def matches(text: str, pattern: str, needs: str = "true") -> Column:
    """All matches as structs of value, start and end (code points, end exclusive). pattern: a SQL expression."""
    found = f"case when {needs} then regexp_extract_all({text}, {pattern}, 0) else array() end"
    gaps = f"case when {needs} then transform(split({text}, {pattern}, -1), g -> length(g)) else array() end"
    ends = let("transform(found.m, (v, i) -> found.g[i] + length(v))", "x", running("x", "{0} + {1}"))
    spans = let(ends, "e", "transform(found.m, (v, i) -> named_struct('value', v, 'start', e[i] - length(v), 'end', e[i]))")
    return F.expr(let(f"named_struct('m', {found}, 'g', {gaps})", "found", spans))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column for each kind: its spans that pass the checks."""
    for kind, pattern in PATTERNS.items():
        docs = docs.withColumn(kind, matches(text, f"r'{pattern}'", NEEDS[kind].format(text)))
    for kind in PATTERNS:
        docs = docs.withColumn(kind, F.expr(f"filter({kind}, x -> {VALID[kind]})"))
    return docs


def entities(kinds=tuple(PATTERNS)) -> Column:
    """All spans of a row with what identifies their entity."""
    one = {k: f"lower(x.value)" if k in ("email", "ip") else _DIGITS for k in kinds}
    return F.flatten(F.array(*(F.expr(f"transform({k}, x -> named_struct('entity', concat('{k}:', {one[k]}), 'start', x.start, 'end', x.end))") for k in kinds)))


#: Code points of a text's blocks, where it has many spans.
BLOCK = 4096


def covered(text: str, kinds, name: str, more: str = "''") -> str:
    """SQL of the text with `name` (an expression of the span s) in place of each span; spans that overlap become one, named by the first.

    `more` (of s and `before`, where the spans before it end) stands for a span that overlaps an earlier one. What stays is
    cut out of blocks of the text, so many spans don't read a long text from its start again and again.
    """
    every = ", ".join(f"transform({k}, x -> named_struct('start', x.start, 'end', x.end, 'kind', '{k}'))" for k in kinds)
    piece = (  # n code points from `a` on
        "case when n <= 0 then '' when a div z = (a + n - 1) div z then substring(t[cast(a div z as int)], cast(a % z + 1 as int), cast(n as int)) else concat("
        "substring(t[cast(a div z as int)], cast(a % z + 1 as int)), array_join(slice(t, cast(a div z as int) + 2, greatest(0, cast((a + n - 1) div z as int) - cast(a div z as int) - 1)), ''), "
        "substring(t[cast((a + n - 1) div z as int)], 1, cast((a + n - 1) % z + 1 as int))) end"
    )
    cut_out = lambda a, n: let(a, "a", let(n, "n", piece))
    ends = let("transform(j, s -> s.end)", "x", running("x", "greatest({0}, {1})"))
    each = let("case when i = 0 then 0 else m[i - 1] end", "before", f"case when s.start >= before then concat({cut_out('before', 's.start - before')}, {name}) else {more} end")
    tail = cut_out("m[size(m) - 1]", f"length({text}) - m[size(m) - 1]")
    whole = f"concat(array_join(transform(j, (s, i) -> {each}), ''), {tail})"
    blocks = f"case when z = {BLOCK} then regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0) else array({text}) end"
    body = let(f"case when size(j) > 32 then {BLOCK} else 2147483647 end", "z", let(blocks, "t", let(ends, "m", whole)))
    return let(f"array_sort(concat({every}))", "j", f"case when size(j) = 0 then {text} else {body} end")


def bare(text: str) -> str:
    """SQL of the text with blanks in place of the base spans: all else keeps its position."""
    return covered(text, PATTERNS, "repeat(' ', s.end - s.start)", "repeat(' ', greatest(0, s.end - before))")


def disclosing_terms(docs: DataFrame, text_col: str = "text", alpha: float = 0.9) -> DataFrame:
    """(tkey, terms): for texts with terms that disclose an entity of any text, those terms. tkey is xxhash64 of the text.

    Terms meet by their 64-bit hashes, small sets of them by a broadcast, others (16 MB and more) by a shuffle.
    """
    texts = docs.select(F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text")).where("text is not null").dropDuplicates(["tkey"])
    found = with_base(texts).select("tkey", F.array_distinct(F.transform(entities(), lambda e: e.entity)).alias("entities"), F.expr(bare("text")).alias("text"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    texts = cut(found.select("tkey", "entities", words.alias("terms")), "text-terms")
    n_texts = texts.count()
    own = texts.where(F.size("entities") > 0)
    mentions = own.select("tkey", F.explode("entities").alias("entity"))
    n_entity = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # entities of one text alone are alike for all of its terms: one stands for them
    alike = F.when(F.col("n_entity") == 1, F.concat(F.lit("one:"), F.col("tkey").cast("string"))).otherwise(F.col("entity"))
    several = mentions.join(n_entity.where("n_entity > 1"), "entity", "left").withColumn("n_entity", F.coalesce("n_entity", F.lit(1)))
    mentions = cut(several.where(F.col("n_entity") < n_texts).select("tkey", alike.alias("entity"), "n_entity").distinct(), "mentions")
    carries = F.log2(F.lit(float(n_texts)) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(n_texts)) / (F.col("n_entity") * F.col("n_term")))
    # n_both is n_entity at most, so only terms of so many texts can pass (and a little more, for rounding)
    most = F.pow(F.col("n_entity"), F.lit(alpha)) * float(max(n_texts, 1)) ** (1 - alpha) * (1 + 1e-9)
    top = mentions.agg(F.max(most)).first()[0] or 0.0
    each = F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("term")
    n_term = texts.select((F.size("entities") > 0).cast("long").alias("own"), each).groupBy("term").agg(F.count("*").alias("n_term"), F.sum("own").alias("own"))
    n_term = cut(n_term.where((F.col("own") > 0) & (F.col("n_term") <= top)).select("term", "n_term"), "terms-counted")
    both = own.select("tkey", each).join(small(n_term), "term").join(mentions, "tkey").where(F.col("n_term") <= most)
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    telling = cut(pairs.where(pmi >= alpha * carries).select("term").distinct(), "telling")
    words = texts.select("tkey", F.explode("terms").alias("word")).withColumn("term", F.xxhash64("word"))
    return words.join(small(telling), "term", "left_semi").groupBy("tkey").agg(F.sort_array(F.collect_set("word")).alias("terms"))


def find_pii(docs: DataFrame, text_col: str = "text", broadcast_mb: int = 16, **how) -> DataFrame:
    """docs with columns email, ip, card, phone and term: arrays of spans (value, start, end)."""
    terms = cut(disclosing_terms(docs.select(F.col(text_col).alias("text")), **how), "terms")
    if (terms.agg(F.sum(F.lit(64) + F.octet_length(F.array_join("terms", " ")) + 32 * F.size("terms"))).first()[0] or 0) <= broadcast_mb << 20:
        terms = F.broadcast(terms)
    kinds = (*PATTERNS, "term")
    others = [c for c in docs.columns if c != text_col and c.lower() not in kinds]
    own = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(text_col).alias("given"))  # no name of the input can clash below
    found = own.withColumn("tkey", F.xxhash64("given")).join(terms, "tkey", "left").withColumn("text", F.coalesce("given", F.lit("")))
    found = with_base(found).withColumn("text", F.expr(f"case when terms is not null then {bare('text')} end"))
    pattern = r"concat(r'(?iu)(?<![\p{L}\p{M}\p{N}])(?:', array_join(terms, '|'), r')(?![\p{L}\p{M}\p{N}])')"
    found = found.withColumn("term", F.coalesce(matches("text", pattern, "terms is not null"), F.array()))
    return found.select(*(F.col("given").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in kinds), *kinds)


def spans_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""
    return F.array_join(F.flatten(F.array(*(F.expr(f"transform({k}, x -> concat_ws(':', '{k}', x.start, x.end))") for k in kinds))), ",")


def sanitized(found: DataFrame, text_col: str = "text", remove_terms: bool = False) -> Column:
    """The text with each span generalised to its kind in brackets; spans that overlap become one, named by the first."""
    name = "case when s.kind = 'term' then '' else concat('[', upper(s.kind), ']') end" if remove_terms else "concat('[', upper(s.kind), ']')"
    return F.expr(covered(text_col, [*PATTERNS, "term"], name))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(spans_text(tuple(PATTERNS)), 256).alias("base_sha256"), spans_text((*PATTERNS, "term")).alias("spans"))


def _span_sql(kind: str, pattern: str, valid: str) -> str:
    """DuckDB: the spans of one kind in text t, as structs of kind, s and e."""
    pattern = pattern.replace("'", "''")
    every = (
        f"list_transform(list_zip(regexp_extract_all(t, '{pattern}'), range(1, len(regexp_extract_all(t, '{pattern}')) + 1)), lambda z: {{'v': z[1], "
        f"'e': CAST(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:z[2]], lambda g: length(g))) + list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:z[2]], lambda g: length(g))) AS BIGINT)}})"
    )
    return f"list_transform(list_filter({every}, lambda x: {valid}), lambda x: {{'k': '{kind}', 'v': x.v, 's': x.e - length(x.v), 'e': x.e}})"


_DIGITS_SQL = "regexp_replace(x.v, '[^0-9]', '', 'g')"
_LUHN_SQL = f"list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS_SQL}), i, 1) AS INT) ELSE 2 * CAST(substr(reverse({_DIGITS_SQL}), i, 1) AS INT) // 10 + 2 * CAST(substr(reverse({_DIGITS_SQL}), i, 1) AS INT) % 10 END)) % 10 = 0"
_SPANS_SQL = {
    "email": _span_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": _span_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.v, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
    "card": _span_sql("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS_SQL}) BETWEEN 13 AND 19 THEN {_LUHN_SQL} ELSE false END"),
    "phone": _span_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 9 AND 15"),
}
_ENTITY_SQL = "x.k || ':' || CASE WHEN x.k IN ('email', 'ip') THEN lower(x.v) ELSE regexp_replace(x.v, '[^0-9]', '', 'g') END"
_RUN = r"[\p{L}\p{M}\p{N}]+"
_WORD_SQL = r"length(x) > 2 OR regexp_matches(x, '^[\p{Lu}\p{Lo}][\p{L}\p{M}]$')"
#: The same by plain means: positions from the pieces between the matches, words as runs, co-occurrence as a join.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), u AS (SELECT DISTINCT t, text IS NULL AS none FROM (SELECT text, coalesce(text, '') AS t FROM documents)),
b AS (SELECT t, bool_and(none) AS none, {", ".join(f"{x} AS {k}" for k, x in _SPANS_SQL.items())} FROM u GROUP BY t),
c AS (SELECT *, email || ip || card || phone AS spans FROM b),
e AS (SELECT *, CASE WHEN len(spans) = 0 THEN t ELSE array_to_string(list_transform(list_zip(string_split(t, ''), range(0, length(t))), lambda z: CASE WHEN len(list_filter(spans, lambda x: x.s <= z[2] AND z[2] < x.e)) > 0 THEN ' ' ELSE z[1] END), '') END AS bare FROM c),
w AS (SELECT *, regexp_extract_all(bare, '{_RUN}') AS runs, string_split_regex(bare, '{_RUN}') AS gaps FROM e),
words AS (SELECT t, none, list_distinct(list_transform(list_filter(runs, lambda x: {_WORD_SQL}), lambda x: lower(x))) AS terms, list_distinct(list_transform(spans, lambda x: {_ENTITY_SQL})) AS entities FROM w),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM words WHERE NOT none),
m0 AS (SELECT t, unnest(entities) AS entity FROM words WHERE NOT none), ne AS (SELECT entity, count(*) AS n_entity FROM m0 GROUP BY entity),
m AS (SELECT DISTINCT t, CASE WHEN n_entity = 1 THEN 'one:' || md5(t) ELSE entity END AS entity, n_entity FROM m0 JOIN ne USING (entity), n WHERE n_entity < n),
each AS (SELECT t, unnest(terms) AS term FROM words WHERE NOT none), nt AS (SELECT term, count(*) AS n_term FROM each GROUP BY term),
pairs AS (SELECT entity, term, count(*) AS n_both, any_value(n_entity) AS n_entity, any_value(n_term) AS n_term FROM m JOIN each USING (t) JOIN nt USING (term) GROUP BY entity, term),
telling AS (SELECT list(DISTINCT term) AS ts FROM pairs, n WHERE log2(n_both * n / (n_entity * n_term)) >= 0.9 * log2(n / n_entity)),
f AS (SELECT w.*, list_transform(list_filter(list_zip(runs, range(1, len(runs) + 1)), lambda z: list_contains(l.own, lower(z[1]))), lambda z: {{'k': 'term', 'v': z[1],
  's': CAST(list_sum(list_transform(gaps[1:z[2]], lambda g: length(g))) + coalesce(list_sum(list_transform(runs[1:z[2] - 1], lambda g: length(g))), 0) AS BIGINT), 'e': CAST(list_sum(list_transform(gaps[1:z[2]], lambda g: length(g))) + list_sum(list_transform(runs[1:z[2]], lambda g: length(g))) AS BIGINT)}}) AS term
  FROM w JOIN (SELECT t, list_intersect(terms, coalesce(ts, [])) AS own FROM words, telling) l USING (t))
SELECT d.doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone, sha256(array_to_string(list_transform(spans, lambda x: concat_ws(':', x.k, x.s, x.e)), ',')) AS base_sha256,
  array_to_string(list_transform(spans, lambda x: concat_ws(':', x.k, x.s, x.e)) || list_transform(term, lambda x: concat_ws(':', x.k, x.s, x.e)), ',') AS spans FROM d JOIN f ON f.t = d.t
"""
