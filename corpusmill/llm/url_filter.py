"""URL filtering: prefix rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table: each block of 512 bits (eight 64-bit words) is a row, built by one aggregation of the listed URLs. A
URL looks up one block and one bit in each of its words. URLs that the filter excludes are done; the possible hits alone can
meet the list in an exact join on the canonical URL, which removes the false positives. The pages are read once.

Defined cases. Null URL or one without `://`: host and path are empty, no rule fits, and as the list holds no empty URL the
verdict is `allow`. Repeated rows: each gets its verdict. Empty list or table: nothing is blocked, no rows. Very long URLs:
whole. Columns of the input named `host`, `path`, `rule`, `verdict` or `listed` are replaced; any other name is kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table

# fixed values: the contract's rules (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
WORDS_PER_BLOCK = 8
KEYS_PER_BLOCK = 32
#: Odd multipliers, one for each word of a block.
SALTS = tuple(2 * (0x9E3779B1 * (i + 1) % (1 << 30)) + 1 for i in range(WORDS_PER_BLOCK))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    host, path = parts(F.col("_url"))
    return pages.withColumn("_url", F.coalesce(F.col(url_col), F.lit(""))).withColumn("host", host).withColumn("path", path).drop("_url")


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def canonical() -> Column:
    """One spelling for a page: no scheme, user, default port, `www.` or `m.`, query, fragment, `.html` or last slash."""
    host = F.regexp_replace(F.regexp_replace("host", r"^[^@]*@", ""), r":(80|443)?$", "")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace("path", r"(/|\.html)+$", ""))


def _bits(h: Column) -> list[Column]:
    """The bit that a hash takes in each word of its block."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.shiftright(low * F.lit(s), 20).bitwiseAND(F.lit(63)).cast("int") for s in SALTS]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the listed `canon`."""
    h = F.col("h")
    x = listed.select(F.xxhash64("canon").alias("h"))
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias(f"w{i}") for i, b in enumerate(_bits(h))]
    return x.groupBy(F.pmod(F.shiftright(h, 31), F.lit(n_blocks)).alias("block")).agg(*words)


ADDED = ("host", "path", "rule", "verdict", "listed")


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """pages with host, path, rule, verdict and `listed` (whether the list has the URL). listed: a column `canon`."""
    listed = cut(listed.select("canon").where("canon is not null and canon != ''").distinct(), "listed")
    n_blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    blocks = bloom_blocks(listed, n_blocks)
    rule, verdict = rule_of(rules)
    kept = F.struct(F.lit(0).alias("_"), *(c for c in pages.columns if c.lower() not in ADDED)).alias("page")  # no name of the input can clash below
    judged = with_parts(pages.select(kept, F.col(url_col).alias("url"))).withColumn("rule", rule).withColumn("verdict", verdict).withColumn("canon", canonical()).withColumn("h", F.xxhash64("canon"))
    fits = 80 * n_blocks <= broadcast_bytes
    probed = judged.withColumn("block", F.pmod(F.shiftright("h", 31), F.lit(n_blocks))).join(F.broadcast(blocks) if fits else blocks, "block", "left")
    possible = F.lit(True)
    for i, b in enumerate(_bits(F.col("h"))):
        possible &= F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1
    # what the filter excludes gets a key that nothing has, another for each URL, and so stays spread out
    key = F.when(F.coalesce(possible, F.lit(False)), F.col("canon")).otherwise(F.concat(F.lit("\n"), F.hex("h")))
    hits = probed.withColumn("canon", key).join(small(listed.withColumn("listed", F.lit(True)), broadcast_bytes), "canon", "left")
    found = F.coalesce("listed", F.lit(False))
    method = F.when(found, F.lit("block")).otherwise(F.lit("allow"))
    return hits.select(*(F.col("page")[c].alias(c) for c in pages.columns if c.lower() not in ADDED), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), found.alias("listed"))


#: Words in host names that put a page of the query's table on its list.
LISTED_WORDS = ("casino", "adult", "pills", "porn", "viagra", "poker", "betting")


def listed_urls(pages: DataFrame, rules=RULES, words: tuple[str, ...] = LISTED_WORDS, url_col: str = "url") -> DataFrame:
    """The list of the query: canonical URLs of the pages that the rules block and of those whose host names a listed word.

    So other spellings of a blocked page are caught, and pages that no rule speaks of.
    """
    _, verdict = rule_of(rules)
    wanted = F.coalesce(verdict, F.lit("")) == "block"
    if words:
        wanted |= F.col("host").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")
    return with_parts(pages, url_col).where(wanted).select(canonical().alias("canon")).distinct()


def rejected_urls(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """The canonical URLs of the pages that the rules block."""
    return listed_urls(pages, rules, (), url_col)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
r AS (SELECT q.*, (SELECT max_by({'rule': h || p, 'action': action}, length(h || p)) FROM rules
                   WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, p)) AS best,
             regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)+$', '') AS canon FROM q),
listed AS (SELECT DISTINCT canon FROM r WHERE (best.action = 'block' OR regexp_matches(host, '(^|[.-])(casino|adult|pills|porn|viagra|poker|betting)([.-]|$)')) AND canon <> '')
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.action, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
