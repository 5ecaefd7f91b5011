"""Passes of a fit: slices of encoded sequences, derivatives by words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.operators import regression as G
from strandlab.operators import scoring as E


@pytest.mark.parametrize("width, length, bidirect", [(40, 9, True), (40, 10, True), (40, 11, False), (12, 3, True), (9, 9, True), (5, 9, True), (40, 2, True)])
def test_derivatives_by_words_equal_those_by_letters(width, length, bidirect):
    rng = np.random.default_rng(width + length)
    codes = rng.integers(0, 5, (50, width)).astype(np.uint8)
    nuc, spat, bins = rng.dirichlet([1] * 4, length), np.array([0.2, 0.5, 0.3]), G.bin_of(width, width // 3, 3, True)
    d, s = G.derivatives(codes, nuc, spat, bins, bidirect)
    if width < length:
        assert not d.any() and not s.any()
        return
    plain_d, plain_s = G._plain_derivatives(codes, nuc, spat, bins, bidirect)
    assert d == pytest.approx(plain_d, rel=1e-12) and s == pytest.approx(plain_s, rel=1e-12)


def test_a_pass_reads_slices_and_no_rows(spark):
    rows = [(i, "ACGTTGCAGA" if i % 3 else "ACGNACG", float(i)) for i in range(600)]
    sums = G.SparkSums(spark.createDataFrame(rows, "seq_id bigint, seq string, y double").coalesce(1), ["y"], 1)
    assert sums.rows.count() == 2  # a row for each length
    request = G.Request(np.full((3, 4), 0.25), np.ones(1), np.zeros(50, int), True, "gram")
    n, total = sums(request)[:2]
    assert (n, total) == (600, sum(range(600)))
    sums.close()


def test_energies_by_words_equal_window_scores():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 5, (31, 30)).astype(np.uint8)
    for length in (1, 4, 9, 30):
        motif = E.Motif.of("m", rng.dirichlet([0.5] * 4, length))
        for spat in (E.Spatial(), E.Spatial((0.5, 2.0, 1.0), 10)):
            for bidirect in (True, False):
                want = E.log_sum(np.concatenate(E.window_scores(codes, motif, spat, bidirect), axis=1))
                assert E.energies(codes, motif, spat, bidirect, "logSumExp") == pytest.approx(want, rel=1e-12)


def test_a_fit_makes_its_rows_once(spark):
    """The rows are made once for the search, the kind of response and the score."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seq(i):
        made.add(1)
        return "ACGTTGCAGATTACAGATTACCGTATTGCA"[i % 4 :][:24]

    df = spark.range(40).select(F.col("id").alias("seq_id"), seq("id").alias("seq"), (F.col("id") % 5).cast("double").alias("y"))
    G.regress_pwm(df, "y", "GATTA", G.Options(motif_length=5, spat_num_bins=3, spat_bin_size=8, max_steps=1))
    assert made.value == 40
