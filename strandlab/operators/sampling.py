"""Sampling and cross-validation folds, reproducible by seeded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators.ranks import draw, draw_cell, ranked
from strandlab.operators.stats import quantiles


def quantile_matched_rows(df: DataFrame, reference: str, sample_fraction: float, num_quantiles: int = 10, seed: int = 60427, key: str = "seq_id") -> DataFrame:
    """Equally many rows of each quantile bin of ``reference``: the smallest bin's size or fraction / bins of all, whichever is less."""
    total = df.count()
    size = int(total * sample_fraction)
    if size < 1:
        raise ValueError(f"a sample fraction of {sample_fraction} is too small for {total} rows")
    bins = min(size, num_quantiles)
    cuts = quantiles(df, reference, [i / bins for i in range(bins + 1)], []).first().quantiles
    cuts = sorted(set(cuts))
    # Bins are closed on the right, the first on both sides.
    bin_no = sum(((F.col(reference) > c).cast("int") for c in cuts[1:-1]), F.lit(0))
    binned = df.withColumn("__bin", bin_no)
    least = binned.groupBy("__bin").count().agg(F.min("count")).first()[0]
    n = min(least, size // bins)
    return _drawn(binned, "__bin", seed, key).where(F.col("__rank") < n).drop("__bin", "__rank")


def _drawn(df: DataFrame, by: str, seed: int, key: str) -> DataFrame:
    """``df`` with __rank, the place of each row in its group's random order."""
    drawn = df.withColumn("__draw", draw(key, seed))
    return ranked(drawn, [by], draw_cell(F.col("__draw")), ["__draw", key], "__rank", "__rows").drop("__draw", "__rows")


def sample_response(df: DataFrame, response: str, sample_frac: float | tuple[float, float] | None = None, sample_ratio: float = 1, seed: int = 60427, key: str = "seq_id") -> DataFrame:
    """Binary: a share of the zeros and of the ones (by default all ones and ``sample_ratio`` times as many zeros).
    Otherwise: rows matched by quantiles of the response, a tenth by default."""
    r = df.agg(F.sum((F.col(response) == 1).cast("long")).alias("ones"), F.sum((F.col(response) == 0).cast("long")).alias("zeros"), F.count(F.lit(1)).alias("n")).first()
    if (r.ones or 0) + (r.zeros or 0) != r.n:
        return quantile_matched_rows(df, response, sample_frac or 0.1, seed=seed, key=key)
    if sample_frac is None:
        sample_frac = (min(1.0, sample_ratio * r.ones / r.zeros) if r.zeros else 1.0, 1.0)
    elif not isinstance(sample_frac, tuple):
        sample_frac = (sample_frac, sample_frac)
    most = F.when(F.col(response) == 0, F.lit(round(sample_frac[0] * r.zeros))).otherwise(F.lit(round(sample_frac[1] * r.ones)))
    return _drawn(df, response, seed, key).where(F.col("__rank") < most).drop("__rank")


def cv_folds(df: DataFrame, nfolds: int, categories: str | None = None, seed: int = 60427, key: str = "seq_id", compat: bool = False) -> DataFrame:
    """``df`` with fold 1..nfolds, even within each category; the first folds hold one row more where it doesn't come out even.

    ``compat``: contiguous blocks by key instead of a shuffle; a key that isn't a
    number is then ordered by a window over the category.
    """
    by = [categories] if categories else []
    if compat:
        if dict(df.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
            return df.withColumn("fold", F.ntile(nfolds).over(Window.partitionBy(*by).orderBy(key)))
        rows = ranked(df, by, F.floor(F.col(key) / 4096), [key], "__rank", "__rows")
    else:
        rows = df.withColumn("__draw", draw(key, seed))
        rows = ranked(rows, by, draw_cell(F.col("__draw")), ["__draw", key], "__rank", "__rows").drop("__draw")
    size, more = F.floor(F.col("__rows") / nfolds), F.col("__rows") % nfolds
    large = more * (size + 1)  # rows in the larger folds
    fold = F.when(F.col("__rank") < large, F.floor(F.col("__rank") / (size + 1))).otherwise(more + F.floor((F.col("__rank") - large) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("__rank", "__rows")
