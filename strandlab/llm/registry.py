"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlab.llm import chat, decontam, exact_dedup, hardneg, htmltext, importance, neardup, packing, pii, quality, tokens, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash": neardup.op1_bag_minhash,
    "op2_nearest_url_text": htmltext.op2_nearest_url_text,
    "op3_length_histogram": tokens.op3_length_histogram,
    "op4_length_buckets": packing.op4_length_buckets,
    "op6_bm25_decontamination": decontam.op6_bm25_decontamination,
    "op7_feistel_pseudonyms": pii.op7_feistel_pseudonyms,
    "op8_nearest_toxic": toxicity.op8_nearest_toxic,
    "op9_perspective_rotation": chat.op9_perspective_rotation,
    "op10_compression_quality": quality.op10_compression_quality,
    "op5_tree_merge_dedup": exact_dedup.op5_tree_merge_dedup,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_fagin_hard_negatives": hardneg.op12_fagin_hard_negatives,
    "op13_wildcard_url_filter": urlfilter.op13_wildcard_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op5_tree_merge_dedup": exact_dedup.SQL,
    "op9_perspective_rotation": chat.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_fagin_hard_negatives": hardneg.SQL,
    "op13_wildcard_url_filter": urlfilter.SQL,
}
