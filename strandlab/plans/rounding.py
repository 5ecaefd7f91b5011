"""Both engines' floating-point results are rounded to six digits before they are compared."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
#: Floating-point columns of each query that has SQL.
COLUMNS = {
    "screen_kmers": "max_r2 avg_n avg_var price is_low",
    "screen_kmers_gapped": "max_r2 avg_n avg_var price",
    "all_motif_datasets": "A C G T",
    "get_motif_pssm": "A C G T",
    "pssm_add_prior": "A C G T",
    "bits_per_pos": "bits",
    "pssm_theoretical": "min_score max_score",
    "pssm_quantile": "score",
    "pssm_rc": "A C G T",
    "pssm_trim": "A C G T",
    "pssm_concat": "A C G T",
    "kmers_to_pssm": "A C G T",
    "logo_heights": "height",
    "compute_pwm": "pwm",
    "compute_pwm_one_strand": "pwm",
    "compute_pwm_max": "pwm",
    "compute_pwm_spatial": "pwm",
    "compute_pwm_range": "pwm",
    "compute_pwm_native": "pwm",
    "extract_pwm": "pwm",
    "calc_seq_pwm": "EBOX GATA",
    "calc_seq_pwm_unknown": "pwm",
    "compute_local_pwm": "pwm",
    "screen_pwm_r2": "score",
    "screen_stream": "score",
    "screen_pwm_ks": "score",
    "ks_distance": "D",
    "screen_pwm_clusters": "D",
    "motif_enrichment_relative": "enrichment",
    "motif_enrichment_absolute": "enrichment",
    "pwm_quantiles": "q50 q90 q99",
    "running_mean": "smooth",
    "motif_db": "A C G T",
    "motif_db_to_dataframe": "A C G T",
    "motif_db_score": "pwm",
    "pssm_dataset_cor": "score",
    "pssm_dataset_cor_pearson": "score",
    "pssm_dataset_diff": "score",
    "pssm_match": "cor",
    "gextract_pwm": "pwm",
    "gextract_local_pwm": "pwm",
    "gpwm_quantiles": "q10 q50 q90",
    "gextract_pwm_quantile": "pwm q",
    "interval_quantiles_random_background": "pwm q",
    "least_squares": "intercept slope",
    "fixed_model_predict": "pred",
    "fixed_model_score": "r2 intercept slope",
    "fixed_model_moments": "total with_price",
    "regress_step_scores": "r2",
    "regress_first_moves": "r2",
    "r_squared": "r2",
    "interpolate": "v",
    "prediction_curves": "pred above d",
    "spatial_model": "spat_factor",
} | {f"{name}_distribution": " ".join(map("".join, product("ACGT", repeat=n))) for name, n in (("dinucleotide", 2), ("trinucleotide", 3))}


def rounded(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    if name not in COLUMNS:
        return query

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Adding zero turns a rounded -0.0 into 0.0.
        return query(spark, sf_dir).withColumns({c: F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0) for c in COLUMNS[name].split()})

    return run


def rounded_sql(name: str, sql: str) -> str:
    if name not in COLUMNS:
        return sql
    replaced = ", ".join(f'round(CAST("{c}" AS DOUBLE), {DIGITS}) + 0.0 AS "{c}"' for c in COLUMNS[name].split())
    return f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS unrounded"
