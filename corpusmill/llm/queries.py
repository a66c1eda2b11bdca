"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, mixing, near_dedup, packing, pii, repeats, sharding, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_external_shuffle": sharding.op1_external_shuffle,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_threshold_topk": topk.op3_threshold_topk,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_repeated_bytes": repeats.op6_repeated_bytes,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_simhash_fingerprints": fingerprints.op9_simhash_fingerprints,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": near_dedup.SQL,
    "op3_threshold_topk": topk.SQL,
    "op4_pii": pii.SQL,
    "op6_repeated_bytes": repeats.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_mix_sources": mixing.SQL,
}
