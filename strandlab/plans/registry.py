"""Registered queries of the motif engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlab.plans import library_queries, pssm_queries, regression_queries, scoring_queries, sequence_queries
from strandlab.plans.rounding import rounded, rounded_sql

_MODULES = (sequence_queries, pssm_queries, scoring_queries, library_queries, regression_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_queries.QUERIES["screen_kmers"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: rounded(name, f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: rounded_sql(name, s) for m in _MODULES for name, s in m.SQL.items()}
