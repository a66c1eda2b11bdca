"""Toxicity by a weighted finite-state grammar over clauses.

Transducers read a clause's tokens and write a factor for each: negation opens a scope of a few tokens in which insults count
less, reported speech lasts to the clause's end and halves them, a target nearby (read from both sides) raises them, and a
threat counts only when a target follows its verb. They are composed into one machine, whose states are built as they are
met. A clause scores the weights of its insults and threats times the factors written for them; a document the sum over
its clauses, turned into a probability.

The lexicon: a few fixed words of English, and terms learned from labelled documents - words and beginnings of words (for
inflected forms) that stand much more often in toxic ones. It is fitted on `sample` labelled documents at most, chosen by a
hash of doc_id among those whose crc32(doc_id) modulo 5 isn't 0; all terms that pass the thresholds are in it (the sample
bounds them). Scores look at the text alone. An automaton finds the terms in whole texts; only clauses with a term are read
by the grammar, each once, so the time is linear in a text's length.

Defined cases. Null or empty text: the score of a text without any match. Null labels or doc_ids: not learned from. No
labels at all: the fixed words alone. Repeated rows: equal scores. Very long texts: read whole. Empty table: no rows. Columns
of the input that are named like the added ones (`score`, `predicted`, or the names given) are replaced, others are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, slices, table

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin", "filth", "parasite")
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "strangle", "murder", "burn", "crush")
TARGETS = frozenset("you your yours yourself u ur he him his she her they them their these those people everyone".split())
NEGATIONS = frozenset("not no never none nobody isnt arent wasnt dont doesnt didnt cannot cant without hardly".split())
REPORTING = frozenset("said says say saying told tells wrote writes quoted quote quotes claimed claims alleged allegedly called reportedly according".split())
SCOPE = 3
#: Made-up labelled rows on either side.
PRIOR = 8
_CLAUSE = re.compile(r"[.!?;:\n\r]")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


class Transducer:
    """arcs: {(state, token class): (next state, factor)}; a class without an arc takes the state's `*`, else it stays there."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, float]]):
        self.arcs = arcs

    def step(self, state: int, kind: str) -> tuple[int, float]:
        return self.arcs.get((state, kind)) or self.arcs.get((state, "*")) or (state, 1.0)


def _countdown(opened_by: str, n: int, factor: float, closed_by: dict[str, float]) -> Transducer:
    """After a token of the class opened_by, those of the classes closed_by within n tokens get their factor."""
    arcs: dict[tuple[int, str], tuple[int, float]] = {(0, "*"): (0, 1.0)}
    for s in range(n + 1):
        arcs[s, opened_by] = (n, 1.0)
        if s:
            arcs[s, "*"] = (s - 1, 1.0)
            arcs |= {(s, k): (s - 1, f * factor) for k, f in closed_by.items()}
    return Transducer(arcs)


NEGATION = _countdown("N", SCOPE, 0.3, {"I": 1.0, "V": 1.0})
TARGET = _countdown("G", SCOPE, 1.5, {"I": 1.0})
REPORTED = Transducer({(0, "R"): (1, 1.0), (1, "I"): (1, 0.6), (1, "V"): (1, 0.6)})
#: Read from the right: a verb counts only with a target not far after it, others stay as they are.
THREAT = Transducer({**{(s, "G"): (4, 1.0) for s in range(5)}, **{(s, "*"): (max(0, s - 1), 1.0) for s in range(5)}, (0, "V"): (0, 0.0), **{(s, "V"): (s - 1, 1.0) for s in range(1, 5)}})


class Composed:
    """Transducers in step; their common states and arcs are made when first met."""

    def __init__(self, *parts: Transducer):
        self.parts, self.known = parts, {}

    def factors(self, kinds: list[str]) -> list[float]:
        state, out = (0,) * len(self.parts), []
        for kind in kinds:
            if (state, kind) not in self.known:
                steps = [p.step(s, kind) for p, s in zip(self.parts, state, strict=True)]
                self.known[state, kind] = tuple(s for s, _ in steps), math.prod(f for _, f in steps)
            state, factor = self.known[state, kind]
            out.append(factor)
        return out


class Grammar:
    """terms: {term: (weight, whole word or the beginning of one, class I or V)}."""

    def __init__(self, terms: dict[str, tuple[float, bool, str]]):
        import ahocorasick

        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        for term in terms:
            self.automaton.add_word(term, len(term))
        if terms:
            self.automaton.make_automaton()
        self.forward, self.backward = Composed(NEGATION, REPORTED), Composed(THREAT)
        self.sides = Composed(TARGET)

    def weight(self, token: str) -> tuple[float, str]:
        """The heaviest term that the token is or begins with."""
        best, kind = 0.0, "F"
        for n in range(3, len(token) + 1):
            if (t := self.terms.get(token[:n])) and (n == len(token) or not t[1]) and t[0] > best:
                best, kind = t[0], t[2]
        return best, kind

    def clause(self, text: str) -> float:
        tokens = _TOKEN.findall(text)
        read = [self.weight(t) for t in tokens]
        kinds = [k if k != "F" else "G" if t in TARGETS else "N" if (bare := t.replace("'", "")) in NEGATIONS else "R" if bare in REPORTING else "F" for t, (_, k) in zip(tokens, read, strict=True)]
        ahead, back = self.forward.factors(kinds), self.backward.factors(kinds[::-1])[::-1]
        left, right = self.sides.factors(kinds), self.sides.factors(kinds[::-1])[::-1]
        return sum(w * a * b * max(x, y) for (w, k), a, b, x, y in zip(read, ahead, back, left, right, strict=True) if k in "IV")

    def score(self, text: str) -> float:
        """The sum over the clauses with a term at the beginning of a word."""
        if not self.terms or not text:
            return 0.0
        text, total, done, last = text.lower(), 0.0, -1, 0
        for end, n in self.automaton.iter(text):
            begin = end - n + 1
            if begin < done or (begin and text[begin - 1].isalnum()):
                continue
            stop = _CLAUSE.search(text, end)
            done = stop.start() if stop else len(text)
            # no separator before the last clause's end need be looked for again
            start = max(max(text.rfind(c, last, begin) for c in ".!?;:\n\r") + 1, last)
            last = done
            total += self.clause(text[start:done])
        return total


def fixed_terms() -> dict[str, tuple[float, bool, str]]:
    return {w: (3.0, False, "I") for w in INSULTS} | {w: (3.0, False, "V") for w in THREATS}


def learned_terms(text_labels: DataFrame, least: int = 5, ratio: float = 4.0, evidence: float = 16.0) -> dict[str, tuple[float, bool, str]]:
    """Words and their beginnings whose frequencies in toxic and clean documents have a log ratio of `ratio` or more.

    With many rare words some stand in toxic documents alone by chance; so the counts must also be unlikely otherwise, by a
    log-likelihood ratio of `evidence` or more. A beginning must be that of three words at least.
    """
    totals = text_labels.groupBy("toxic").count().collect()
    n = {bool(r["toxic"]): r["count"] for r in totals}
    if not n.get(True) or not n.get(False):
        return {}
    words = text_labels.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("w"))
    counted = words.groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    # beginnings add up over words; what they say about documents is close enough, for their words rarely meet in one
    whole = F.array(F.struct(F.col("w").alias("t"), F.lit(True).alias("whole")))
    lengths = F.when(F.length("w") > 3, F.sequence(F.lit(3), F.length("w") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.concat(whole, F.transform(lengths, lambda k: F.struct(F.substring("w", F.lit(1), k).alias("t"), F.lit(False).alias("whole"))))
    each = counted.select("a", "n", F.explode(starts).alias("x")).groupBy("x.t", "x.whole").agg(F.sum("a").alias("a"), F.sum(F.col("n") - F.col("a")).alias("c"), F.count_if(F.col("a") > 0).alias("forms"))
    log = F.log((F.col("a") + 0.1) / n[True]) - F.log((F.col("c") + 0.1) / n[False])
    share, all_ = n[True] / (n[True] + n[False]), F.col("a") + F.col("c")
    likely = F.col("a") * F.log(F.col("a") / (all_ * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (all_ * (1 - share)))).otherwise(0.0)
    top = each.withColumn("w", log).where((F.col("a") >= least) & (F.col("w") >= ratio) & (likely >= evidence) & (F.col("whole") | (F.col("forms") >= 3))).collect()  # bounded by the sample: `least` of its documents hold each
    out: dict[str, tuple[float, bool, str]] = {}
    for r in sorted(top, key=lambda r: (not r["whole"], r["t"])):  # a beginning takes the place of the same whole word
        out[r["t"]] = (min(6.0, r["w"]), r["whole"], "I")
    return out


@lru_cache(maxsize=4)
def _grammar(terms: tuple) -> Grammar:
    return Grammar(dict(terms))


def raw_scores(docs: DataFrame, terms: dict[str, tuple[float, bool, str]], text_col: str, name: str) -> DataFrame:
    """docs with one more column: the grammar's sum."""
    frozen = docs.sparkSession.sparkContext.broadcast(tuple(sorted(terms.items())))
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _grammar(frozen.value)
        for batch in slices(batches):
            yield batch.append_column(name, pa.array([grammar.score(x or "") for x in batch.column(at).to_pylist()], pa.float64()))

    return docs.mapInArrow(score, docs.select("*", F.lit(0.0).alias(name)).schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge on the slope."""
    w = np.array([0.5, -2.0])
    features = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - y) + ridge * len(x) * np.array([w[0], 0.0])
        hessian = (features * (p * (1 - p) + 1e-9)[:, None]).T @ features + ridge * len(x) * np.diag([1.0, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Terms, slope and intercept from `sample` labelled documents at most."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null").where(~held_out("_id"))
    chosen = own.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    own_docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = cut(own_docs.join(F.broadcast(chosen), own_docs["id"] == chosen["_id"]).select("toxic", "text"), "labelled")
    terms = fixed_terms() | learned_terms(texts)
    pairs = raw_scores(texts, terms, "text", "x").select("x", "toxic").orderBy("x", "toxic").limit(2 * sample).collect()  # bounded by the sample, but for repeated ids
    # a few made-up rows on either side, so that a handful of labels (or one class alone) can't turn texts without a match toxic
    x = np.array([*[0.0] * PRIOR, *[6.0] * PRIOR, *(r["x"] for r in pairs)])
    y = np.array([*[0.0] * PRIOR, *[1.0] * PRIOR, *(float(r["toxic"]) for r in pairs)])
    slope, intercept = fit_logistic(x, y)
    return {"terms": terms, "slope": slope, "intercept": intercept}


def score_documents(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with the score (0 to 1) and whether it is 0.5 or more."""
    docs = docs.drop(*(c for c in (score_col, predicted_col) if c != text_col))
    name = free_name(docs, "raw")
    raw = raw_scores(docs, model["terms"], text_col, name)
    z = F.lit(model["slope"]) * F.col(name) + F.lit(model["intercept"])
    return raw.withColumn(score_col, 1 / (1 + F.exp(-z))).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int")).drop(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
