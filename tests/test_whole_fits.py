"""The registered fits and random backgrounds are the operators' whole jobs."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.operators import intervals as I
from strandlab.operators import regression as G
from strandlab.plans import library_queries, regression_queries


def test_fits_have_the_operators_search():
    for o in (regression_queries.OPTIONS, G.Options()):
        assert o.max_steps is None and (o.max_cands, o.kmer_lengths, o.min_gap, o.max_gap) == (10, (8,), 0, 1)


def test_a_fit_goes_on_until_it_converges(monkeypatch):
    """Scores that always rise by more than epsilon for 3000 steps: no cap ends the fit before."""
    calls = []

    class Sums:
        responses = 1

        def __call__(self, request):
            calls.append(request)
            return []

    def scores(kind, parts, q, spats):
        import numpy as np

        return np.full(q.shape[:2], min(len(calls), 3000) * 1e-3), np.full(len(spats), -1.0)

    class Reader:
        def __init__(self, values):
            pass

        def take(self, *shape):
            import numpy as np

            return np.zeros(shape)

    monkeypatch.setattr(G, "_candidate_scores", scores)
    monkeypatch.setattr(G, "_Reader", Reader)
    import numpy as np

    steps = G.fit(Sums(), np.full((1, 4), 0.25), regression_queries.OPTIONS, 64)[3]
    assert steps >= 3000


def test_backgrounds_have_the_operators_size(monkeypatch):
    asked = []
    for name in ("random_intervals", "interval_pwm_quantiles"):
        f = getattr(I, name)
        monkeypatch.setattr(I, name, lambda *a, f=f, **k: asked.append(inspect.signature(f).bind(*a, **k)))
    monkeypatch.setattr(library_queries, "genome", lambda *a: None)
    monkeypatch.setattr(library_queries, "intervals", lambda *a: None)
    for name in ("random_intervals", "interval_quantiles_random_background"):
        library_queries.QUERIES[name](None, "")
    for call in asked:
        call.apply_defaults()
    assert [c.arguments["n"] for c in asked] == [10_000, 10_000] and asked[1].arguments["precision"] == 0.01


def random_data(n=80, width=60, seed=3):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 4, (n, width)).astype(np.uint8)
    word = np.array([2, 0, 3, 0, 0])
    y = rng.normal(size=n)
    for i in range(0, n, 2):
        at = rng.integers(5, 50)
        codes[i, at : at + 5] = word
        y[i] += 2
    return codes, y


LOCAL = G.Options(motif_length=7, spat_num_bins=3, spat_bin_size=20)


class Passes(G.LocalSums):
    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        self.passes = 0

    def many(self, requests):
        self.passes += 1
        return [G.add_up(self.codes, self.y, self.fold, r) for r in requests]

    def __call__(self, request):
        return self.many([request])[0]


@pytest.mark.parametrize("metric", ["r2", "ks", "log"])
def test_lock_step_gives_the_same_models_in_the_passes_of_the_longest(metric):
    codes, y = random_data()
    o = G.replace(LOCAL, score_metric="ks" if metric == "ks" else "r2", log_energy=metric == "log")
    y = (y > 1).astype(float) if metric == "ks" else y
    starts = [G.seed_matrix(k, 7, 0.05) for k in ("GATAA", "CCGTC", "TTTTT", "GA*AA", "ACGTA", "GGGGG", "GATAC", "CATAA", "AAAAA", "TATCG")]
    each = [Passes(codes, y) for _ in starts]
    alone = [G.fit(sums, s, o, 60) for sums, s in zip(each, starts)]
    sums = Passes(codes, y)
    together = G.fit_together(sums, [G.search(s, o, 60, 1) for s in starts])
    for a, b in zip(alone, together):
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2:] == b[2:]
    assert sums.passes == max(s.passes for s in each) < sum(s.passes for s in each) / 3


def test_parts_are_fitted_on_their_own_rows(spark):
    """Spark's masked sums against sums over each part alone, and one pass for all searches of a step."""
    codes, y = random_data(60)
    rows = [(i, "".join("ACGT"[c] for c in row), float(v), int(i % 3 != 0) | int(i % 3 != 1) << 1 | int(i % 3 != 2) << 2) for i, (row, v) in enumerate(zip(codes, y))]
    df = spark.createDataFrame(rows, "seq_id bigint, seq string, y double, __parts bigint")
    starts = [(kmer, k) for k in range(3) for kmer in ("GATAA", "CCGTC")]
    models = G.fits_from(df, ["y"], starts, LOCAL, 60, F.col("__parts"))
    for (kmer, k), m in zip(starts, models):
        own = np.arange(60) % 3 != k
        start = np.maximum(G.seed_matrix(kmer, 7, LOCAL.unif_prior), LOCAL.min_nuc_prob)
        nuc, spat, _, steps = G.fit(G.LocalSums(codes[own], y[own]), start / start.sum(1, keepdims=True), LOCAL, 60)
        assert m.pssm == pytest.approx(nuc) and m.spat == pytest.approx(spat) and m.steps == steps
    scores = G.scores_together(df, [(m, k) for m, (_, k) in zip(models, starts)], ["y"], LOCAL, False)
    for s, m, (_, k) in zip(scores, models, starts):
        one = G.scored(df.where(F.col("__parts").bitwiseAND(F.lit(1 << k)) != 0), m, ["y"], LOCAL, False)
        assert s == pytest.approx(one.score)


def test_cv_and_clusters_equal_fits_one_by_one(spark):
    few = G.replace(LOCAL, max_steps=5)
    codes, y = random_data(60)
    rows = [(i, "".join("ACGT"[c] for c in row), float(v), "abc"[i % 3] if i % 7 else None) for i, (row, v) in enumerate(zip(codes, y))]
    df = spark.createDataFrame(rows, "seq_id bigint, seq string, y double, c string")
    out = G.regress_pwm_cv(df, "y", 3, options=few, motif="GATAA", add_full_model=False)
    fold = {r.seq_id: r.fold for r in out["predictions"].collect()}
    for k, m in enumerate(out["models"], 1):
        own = np.array([fold[i] != k for i in range(60)])
        start = np.maximum(G.seed_matrix("GATAA", 7, few.unif_prior), few.min_nuc_prob)
        assert m.pssm == pytest.approx(G.fit(G.LocalSums(codes[own], y[own]), start / start.sum(1, keepdims=True), few, 60)[0])
    models = G.regress_pwm_clusters(df, "c", few, use_sample=False, motif="GATAA")
    assert sorted(models) == ["a", "b", "c"]
    for c, m in models.items():
        one = G.regress_pwm(df.withColumn("z", F.coalesce((F.col("c") == c).cast("int"), F.lit(0))), "z", "GATAA", few)
        assert m.pssm == pytest.approx(one.pssm) and m.score == pytest.approx(one.score)


def test_vectors_reach_the_driver_in_bounded_numbers(spark, monkeypatch):
    codes, y = random_data(40)
    rows = [(i, "".join("ACGT"[c] for c in row), float(v)) for i, (row, v) in enumerate(zip(codes, y))]
    df = spark.createDataFrame(rows, "seq_id bigint, seq string, y double").repartition(9)
    r = [G.Request(G.seed_matrix(k, 7, 0.05), np.full(3, 1 / 3), G.bin_of(60, 20, 3, True), True, "gram") for k in ("GATAA", "CCGTC", "AAAAA")]
    want = G.LocalSums(codes, y).many(r)
    for fan, largest in ((32, 64 << 20), (2, 64 << 20), (32, 2 * 8 * r[0].size(1)), (32, 1)):
        monkeypatch.setattr(G.SparkSums, "FAN", fan)
        monkeypatch.setattr(G.SparkSums, "LARGEST", largest)
        sums = G.SparkSums(df, ["y"], 1)
        for a, b in zip(sums.many(r), want):
            assert a == pytest.approx(b)
        sums.close()
