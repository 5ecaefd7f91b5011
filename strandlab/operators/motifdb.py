"""A motif database: normalised log matrices, reverse complements, spatial factors.

Holds a tidy table for Spark and validates its invariants when built. Positions
come from the row order within a motif; whatever ``pos`` held is overwritten.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.functions import pssm as P
from strandlab.operators.scoring import Motif, Spatial, collect_motifs, extract_pwm, score_matrix

LETTERS = ["A", "C", "G", "T"]


@dataclass(frozen=True)
class MotifDB:
    """``table``: motif, pos from 1, A, C, G, T log probabilities; ``reverse``: the same for the other strand."""

    table: DataFrame
    reverse: DataFrame
    lengths: dict[str, int]
    prior: float = 0.01
    spat_factors: dict[str, tuple[float, ...]] = field(default_factory=dict)
    spat_bin_size: int = 1
    spat_min: int | None = None
    spat_max: int | None = None

    def __post_init__(self):
        if not 0 < self.prior < 1:
            raise ValueError("prior must be between 0 and 1")
        if any(n <= 0 for n in self.lengths.values()):
            raise ValueError("motif lengths must be positive")
        if self.spat_factors:
            if set(self.spat_factors) != set(self.lengths):
                raise ValueError("spatial factors must be named as the motifs")
            if len({len(f) for f in self.spat_factors.values()}) > 1:
                raise ValueError("all motifs need the same number of spatial bins")
            if any(x < 0 for f in self.spat_factors.values() for x in f):
                raise ValueError("spatial factors must be non-negative")
        if self.spat_bin_size <= 0:
            raise ValueError("the bin size must be positive")
        if self.spat_min is not None and self.spat_max is not None:
            if self.spat_min > self.spat_max:
                raise ValueError("spat_min must not exceed spat_max")
            if self.spat_min < 0:
                raise ValueError("spat_min must not be negative")

    def __len__(self) -> int:
        return len(self.lengths)

    @property
    def names(self) -> list[str]:
        return sorted(self.lengths)

    def __repr__(self) -> str:
        return f"MotifDB({len(self)} motifs, prior {self.prior}, {max(map(len, self.spat_factors.values()), default=1)} spatial bins)"

    def select(self, which: str | list[str] | list[int], pattern: bool = True) -> MotifDB:
        """Motifs by case-insensitive regular expression, exact names (``pattern`` False) or positions in ``names``."""
        items = [which] if isinstance(which, str) else list(which)
        if items and isinstance(items[0], int):
            if any(not 0 <= i < len(self) for i in items):
                raise IndexError("motif number out of bounds")
            chosen = [self.names[i] for i in items]
        elif pattern:
            chosen = [n for n in self.names if any(re.search(p, n, re.I) for p in items)]
        else:
            if missing := [n for n in items if n not in self.lengths]:
                raise KeyError(f"no such motifs: {', '.join(missing)}")
            chosen = items
        only = F.col("motif").isin(chosen)
        return replace(self, table=self.table.where(only), reverse=self.reverse.where(only), lengths={n: self.lengths[n] for n in chosen}, spat_factors={n: f for n, f in self.spat_factors.items() if n in chosen})

    def __getitem__(self, which) -> MotifDB:
        return self.select(which)

    def to_dataframe(self) -> DataFrame:
        """Probabilities without the prior: motif, pos, A, C, G, T."""
        back = [(F.exp(c) * F.lit(1 + 4 * self.prior) - F.lit(self.prior)).alias(c) for c in LETTERS]
        return self.table.select("motif", "pos", *back)

    def with_prior(self, prior: float) -> MotifDB:
        return create_motif_db(self.to_dataframe(), prior, self.spat_factors or None, self.spat_bin_size, self.spat_min, self.spat_max)

    def as_matrix(self) -> DataFrame:
        """Long matrix of logs: row ``motif_pos``, letter columns."""
        return self.table.select(F.concat_ws("_", "motif", "pos").alias("row"), *LETTERS)

    def motifs(self) -> list[Motif]:
        return collect_motifs(self.to_dataframe(), self.prior)

    def spatials(self) -> dict[str, Spatial] | Spatial:
        return {n: Spatial(f, self.spat_bin_size) for n, f in self.spat_factors.items()} or Spatial()

    def score(self, sequences: DataFrame, bidirect: bool = True, **options) -> DataFrame:
        """Long energies of every sequence against every motif."""
        return extract_pwm(sequences, self.motifs(), self.spatials(), self.spat_min or 1, self.spat_max, bidirect, **options)

    def score_wide(self, sequences: DataFrame, bidirect: bool = True) -> DataFrame:
        return score_matrix(sequences, self.motifs(), spat=self.spatials(), spat_min=self.spat_min or 1, spat_max=self.spat_max, bidirect=bidirect)


def create_motif_db(motifs: DataFrame, prior: float = 0.01, spat_factors: dict[str, tuple[float, ...]] | None = None, spat_bin_size: int = 1, spat_min: int | None = None, spat_max: int | None = None, order_col: str = "pos") -> MotifDB:
    """Row-normalises, adds the prior, normalises again and takes logs.

    Rows of a motif are taken in the order of ``order_col``; where it doesn't tell
    them apart, in the order in which they are read (which only files have).
    """
    if not 0 < prior < 1:
        raise ValueError("prior must be between 0 and 1")
    order = Window.partitionBy("motif").orderBy(*([order_col] if order_col in motifs.columns else []), "__row")
    rows = P.validate(motifs).withColumn("__row", F.monotonically_increasing_id()).withColumn("pos", F.row_number().over(order))
    logs = P.with_prior(rows, prior, normalise_first=True).select("motif", "pos", *(F.ln(c).alias(c) for c in LETTERS))
    lengths = {r.motif: r.n for r in motifs.groupBy("motif").agg(F.count(F.lit(1)).alias("n")).collect()}
    return MotifDB(logs, P.reverse_complement(logs), lengths, prior, dict(spat_factors or {}), spat_bin_size, spat_min, spat_max)


def spark_of(db: MotifDB) -> SparkSession:
    return db.table.sparkSession
