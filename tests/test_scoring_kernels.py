"""Tables of words and flat local energies against the plain window scores."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlab.operators import scoring as E


def library(n, length, seed=0):
    rng = np.random.default_rng(seed)
    return [E.Motif.of(f"m{i}", rng.dirichlet([0.4] * 4, length)) for i in range(n)]


def plain(codes, motifs, spats, bidirect, func):
    return np.stack([E.energies(codes, m, s, bidirect, func) for m, s in zip(motifs, spats)], axis=1)


@pytest.mark.parametrize("bidirect", [True, False])
@pytest.mark.parametrize("func", ["logSumExp", "max"])
@pytest.mark.parametrize("product", [E.PRODUCT, 4000])
def test_tables_of_words_equal_window_scores(monkeypatch, bidirect, func, product):
    monkeypatch.setattr(E, "PRODUCT", product)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 5, (23, 40)).astype(np.uint8)
    motifs = library(9, 7)
    for spat in (E.Spatial(), E.Spatial((0.5, 2.0, 0.0, 1.0), 9)):
        spats = [spat] * 8 + [E.Spatial()]
        assert E.library_energies(codes, motifs, spats, bidirect, func) == pytest.approx(plain(codes, motifs, spats, bidirect, func), rel=1e-12)
    long = library(5, 38, seed=4)
    assert E.library_energies(codes, long, [E.Spatial()] * 5, bidirect, func) == pytest.approx(plain(codes, long, [E.Spatial()] * 5, bidirect, func), rel=1e-12)
    only = [E.Spatial((0.0, 0.0), 40)] * 9  # nothing counts
    assert np.isneginf(E.library_energies(codes, motifs, only, bidirect, func)).all()


def test_a_thousand_motifs_by_tables_are_faster():
    codes = np.random.default_rng(2).integers(0, 4, (300, 64)).astype(np.uint8)
    motifs = library(1000, 12)
    spats = [E.Spatial()] * 1000
    began = time.perf_counter()
    got = E.library_energies(codes, motifs, spats, True, "logSumExp")
    middle = time.perf_counter()
    want = plain(codes, motifs, spats, True, "logSumExp")
    ended = time.perf_counter()
    assert got == pytest.approx(want, rel=1e-12)
    assert ended - middle > 3 * (middle - began), (ended - middle, middle - began)  # about six times on an idle machine


def test_unknown_letters_have_no_score_in_a_library(spark):
    df = spark.createDataFrame([(1, "AACGTAANA"), (2, "AACGTAACA"), (3, None), (4, "AC"), (5, "")], "seq_id bigint, seq string")
    for motifs in (library(2, 4), library(6, 4)):
        for r in E.extract_pwm(df, motifs).collect():
            assert (r.pwm is None) == (r.seq_id != 2)
        wide = {r.seq_id: r for r in E.score_matrix(df, motifs).collect()}
        assert wide[1].m0 is None and wide[2].m0 is not None
        assert E.compute_pwm(df.where("seq_id = 1"), motifs[0]).first().pwm is not None


ODD = ["ACGTACGTTTACGNNA", None, "", "ACG", "ACGT", "TTTT", "GATTACA" * 30, "acgtnACGT", "A" * 300]


@pytest.mark.parametrize("bases", [E.BASES, 50, 7])
@pytest.mark.parametrize("spat", [E.Spatial(), E.Spatial((0.5, 0.0, 2.0), 5)])
def test_local_energies_equal_window_scores(spark, monkeypatch, bases, spat):
    monkeypatch.setattr(E, "BASES", bases)
    motif = library(1, 4)[0]
    want = {}
    for i, s in enumerate(ODD):
        row = None if s is None else [None] * len(s)
        if s and len(s) >= 4:
            both = np.logaddexp(*E.window_scores(E.encode([s]), motif, spat, True))[0]
            row[: len(both)] = [None if np.isneginf(v) else float(v) for v in both]
        want[i] = row
    got = {}
    for first, ends, values in E.local_energies(pa.array(ODD), motif, spat, True):
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            got[first + k] = [None if np.isnan(v) else v for v in values[a:b]]
    for i, row in want.items():
        assert got[i] == pytest.approx(row or [])
    df = spark.createDataFrame([(i, s, {"k": i}) for i, s in enumerate(ODD)], "seq_id bigint, seq string, other map<string,int>").coalesce(1)
    local = {r.seq_id: r for r in E.compute_local_pwm(df, motif, spat).collect()}
    for i, row in want.items():
        assert local[i].other == {"k": i} and (local[i].local is None if row is None else local[i].local == pytest.approx(row))
    level = -6.0
    hits = {r.seq_id: r.positions for r in E.screen_local_pwm(df, motif, ">", level, spat).collect()}
    best = {r.seq_id: r.best for r in E.best_position(df, motif, spat).collect()}
    for i, row in want.items():
        scores = [v for v in row or [] if v is not None]
        assert hits[i] == (None if row is None else [k + 1 for k, v in enumerate(row) if v is not None and v > level])
        assert best[i] == (next(k + 1 for k, v in enumerate(row) if v is not None and round(v, 9) == round(max(scores), 9)) if scores else None)


def test_a_very_long_sequence_among_short_ones(spark):
    """Twelve million bases in one row: screened without an array of its energies in the JVM."""
    motif = library(1, 4)[0]
    df = spark.range(200).select(F.col("id").alias("seq_id"), F.when(F.col("id") == 7, F.repeat(F.lit("ACGTTGCA"), 1_500_000)).otherwise(F.lit("ACGTTGCAACGT")).alias("seq")).coalesce(1)
    rows = {r.seq_id: r for r in E.screen_local_pwm(E.best_position(df, motif), motif, ">", 5.0).collect()}
    assert rows[7].best == rows[8].best and rows[7].positions == []
