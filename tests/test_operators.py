import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.operators import intervals as I
from strandlab.operators import motifdb, plots, sampling, scoring, similarity, stats
from strandlab.operators import regression as G
from strandlab.operators import screening as R
from strandlab.operators.scoring import Motif, Spatial
from strandlab.sources import models as models_io
from strandlab.sources import motifs as M
from strandlab.streaming import scoring as streaming
from tests.test_functions import planted, seqs

IDENTITY = np.full((4, 4), 0.1) + 0.6 * np.eye(4)


def identity(prior=0.01):
    return Motif.of("id", IDENTITY, prior)


def values(df, name):
    return [r[name] for r in df.orderBy("seq_id").collect()]


def test_known_energies(spark):
    df = seqs(spark, ["ACGTACGT", "ACNTACGT", "ACG", None])
    one = values(scoring.compute_pwm(df, identity(), bidirect=False), "pwm")
    both = values(scoring.compute_pwm(df, identity()), "pwm")
    assert one[:2] == pytest.approx([-0.8328327, -1.3042138], abs=1e-5) and one[2] is None and one[3] is None
    assert both[:2] == pytest.approx([-0.1396857, -0.5641062], abs=1e-5)
    assert values(scoring.compute_pwm(df, identity(), func="max"), "pwm")[0] == pytest.approx(-0.8336967, abs=1e-5)
    with pytest.raises(ValueError):
        scoring.compute_pwm(df, identity(), func="mean")


def test_local_energies(spark):
    m = Motif.of("id", IDENTITY, prior=0.0)
    local = values(scoring.compute_local_pwm(seqs(spark, ["ACGTACGT", "TGCATGCA", "AC"]), m, bidirect=False), "local")
    assert local[0][:5] == pytest.approx([-1.42670, -9.21034, -9.21034, -9.21034, -1.42670], abs=1e-4) and local[0][5:] == [None] * 3
    assert local[1][:5] == pytest.approx([-9.21034, -5.31852, -9.21034, -5.31852, -9.21034], abs=1e-4)
    assert local[2] == [None, None]


def test_whole_is_the_sum_of_windows(spark):
    rng = np.random.default_rng(5)
    m = Motif.of("m", rng.dirichlet([1] * 4, 15))
    df = seqs(spark, ["".join(rng.choice(list("ACGT"), 300)) for _ in range(4)])
    spat = Spatial((0.5, 1, 2), 100)
    whole = values(scoring.compute_pwm(df, m, spat), "pwm")
    local = values(scoring.compute_local_pwm(df, m, spat), "local")
    for w, parts in zip(whole, local):
        assert w == pytest.approx(np.logaddexp.reduce([p for p in parts if p is not None]), abs=1e-9)
    back = df.withColumn("seq", F.translate(F.reverse("seq"), "ACGT", "TGCA"))
    assert values(scoring.compute_pwm(back, m), "pwm") == pytest.approx(values(scoring.compute_pwm(df, m), "pwm"))
    top = values(scoring.compute_pwm(df, m, func="max"), "pwm")
    assert top == pytest.approx([max(p for p in x if p is not None) for x in values(scoring.compute_local_pwm(df, m), "local")])
    native = df.withColumn("pwm", scoring.native_energy(F.col("seq"), m))
    assert values(native, "pwm") == pytest.approx(values(scoring.compute_pwm(df, m), "pwm"))


def test_screen_local_laws(spark):
    df = seqs(spark, ["ACGTACGTTTACG", "GGGGACGTAA"])
    local = values(scoring.compute_local_pwm(df, identity()), "local")
    t = float(np.median([v for x in local for v in x if v is not None]))
    get = lambda op: values(scoring.screen_local_pwm(df, identity(), op, t), "positions")
    for i, x in enumerate(local):
        assert get(">")[i] == [k + 1 for k, v in enumerate(x) if v is not None and v > t]
        assert set(get(">")[i]) <= set(get(">=")[i]) and set(get("<")[i]) <= set(get("<=")[i])
    with pytest.raises(ValueError):
        get("!=")


def test_masking(spark):
    p = np.array([[0.3, 0.1, 0.3, 0.3], [0.1, 0.3, 0.3, 0.3], [0.1, 0.3, 0.3, 0.3], [0.3, 0.1, 0.3, 0.3]])
    m = Motif.of("m", p, 0.01, normalise_first=False)
    df = seqs(spark, ["ACCGGGGGTTTT", "TTTTTTTTTTTT", "TTTTTTTTACCG", "ACC"])
    masked = values(scoring.mask_sequences(df, m, -4.6, [True] * 4), "masked")
    assert masked == ["NNNNGNNNNNNN", "TTTTTTTTNNNN", "TTTTTTTTNNNN", "NNN"]


def test_extract_matches_single(spark):
    df = seqs(spark, ["ACGTACGTTTACGATCGATTACA", "GGGGACGTAAGATAAG"])
    lib = scoring.collect_motifs(M.library(spark))
    long = {(r.seq_id, r.motif): r.pwm for r in scoring.extract_pwm(df, lib).collect()}
    assert len(long) == 10
    for m in lib:
        for i, v in enumerate(values(scoring.compute_pwm(df, m), "pwm")):
            assert long[i, m.name] == pytest.approx(v)


def test_motif_db(spark):
    two = spark.createDataFrame([(n, 1, *p) for n in ("Abc", "xyz") for p in IDENTITY.tolist()], M.SCHEMA)
    db = motifdb.create_motif_db(two)
    assert len(db) == 2 and db.names == ["Abc", "xyz"] and "2 motifs" in repr(db)
    assert db["ABC"].names == ["Abc"] and db.select(["xyz"], pattern=False).names == ["xyz"] and db[[0]].names == ["Abc"]
    assert db.as_matrix().count() == 8
    back = db.with_prior(0.1).to_dataframe().where("motif = 'xyz'").orderBy("pos").collect()
    assert [r.A for r in back] == pytest.approx(IDENTITY[:, 0])
    for prior in (0, 1, -0.1):
        with pytest.raises(ValueError):
            motifdb.create_motif_db(two, prior)
    for bad in ({"spat_min": 5, "spat_max": 2}, {"spat_min": -1, "spat_max": 2}, {"spat_factors": {"Abc": (-1.0,), "xyz": (1.0,)}}, {"spat_factors": {"q": (1.0,)}}, {"spat_bin_size": 0}):
        with pytest.raises(ValueError):
            motifdb.create_motif_db(two, **bad)
    with pytest.raises(KeyError):
        db.select(["none"], pattern=False)
    with pytest.raises(IndexError):
        db.select([7])
    df = seqs(spark, ["ACGTACGT"])
    assert db.score(df).first().pwm == pytest.approx(values(scoring.compute_pwm(df, identity()), "pwm")[0])
    assert db.score_wide(df).columns == ["seq_id", "Abc", "xyz"]


def test_similarity(spark):
    lib = M.library(spark)
    assert similarity.pssm_cor(M.library(spark, ["GATA"]), M.library(spark, ["GATA"])) == pytest.approx(1)
    assert similarity.pssm_diff(M.library(spark, ["GATA"]), M.library(spark, ["GATA"])) == pytest.approx(0)
    both = {(r.motif1, r.motif2): r.score for r in similarity.dataset_similarity(lib).collect()}
    assert all(both[a, b] == pytest.approx(both[b, a]) for a, b in both) and both["TATA", "TATA"] == 1
    match = similarity.pssm_match(M.library(spark, ["EBOX"]), lib, "kl")
    assert match.columns == ["motif", "kl"] and match.first().motif == "EBOX"
    with pytest.raises(ValueError):
        similarity.dataset_similarity(lib, method="cosine")


def test_ks_and_r2(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(v), 1) for v in rng.normal(0.5, 1, 200)] + [(0, float(v), 0) for v in rng.normal(0, 1, 300)] + [(1, 1.0, 1), (1, 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, v double, y int")
    x1, x0 = (np.sort([v for g, v, y in rows if g == 0 and y == k]) for k in (1, 0))
    grid = np.concatenate([x1, x0])
    gap = np.searchsorted(x1, grid, "right") / len(x1) - np.searchsorted(x0, grid, "right") / len(x0)
    for alternative, expected in (("two.sided", np.abs(gap).max()), ("greater", gap.max()), ("less", (-gap).max())):
        d = {r.g: r.D for r in stats.ks_distance(df, "v", "y", ["g"], alternative).collect()}
        assert d[0] == pytest.approx(expected) and d[1] == 0
    assert 0 < stats.ks_p_value(0.3, 50, 50) < 0.05 < stats.ks_p_value(0.05, 50, 50)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert same.agg(stats.r_squared(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_cluster_screen_matches_plain_ks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ACGT"), 30)), ["a", "b", "c"][i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "seq_id bigint, seq string, cluster string")
    lib = scoring.collect_motifs(M.library(spark, ["GATA", "SPEC"]))
    for alternative in ("two.sided", "greater", "less"):
        got = {(r.motif, r.cluster): r.D for r in R.screen_pwm_clusters(df, "cluster", lib, 0.0, alternative).collect()}
        for c in "abc":
            one = R.screen_pwm(df.withColumn("y", (F.col("cluster") == c).cast("int")), "y", lib, "ks", alternative)
            for r in one.collect():
                assert got[r.motif, c] == pytest.approx(max(0.0, r.score))


def test_running_mean_in_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(round(rng.normal(), 1)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id bigint, e double, r double")
    one, many = (values(stats.running_mean(df, "e", "r", 20, buckets=b), "smooth") for b in (1, 5))
    assert one == pytest.approx(many)


def test_sampling(spark):
    df = spark.createDataFrame([(i, float(i), i % 4 == 0) for i in range(400)], "seq_id bigint, v double, b boolean").withColumn("y", F.col("b").cast("int"))
    sample = sampling.quantile_matched_rows(df, "v", 0.2)
    assert sample.count() == 80 and sample.columns == df.columns
    balanced = {r.y: r["count"] for r in sampling.sample_response(df, "y").groupBy("y").count().collect()}
    assert balanced == {0: 100, 1: 100}
    folds = sampling.cv_folds(df, 4, "y").groupBy("y", "fold").count().collect()
    assert len(folds) == 8 and max(r["count"] for r in folds) - min(r["count"] for r in folds if r.y == folds[0].y) <= 51
    with pytest.raises(ValueError):
        sampling.quantile_matched_rows(df, "v", 0.0001)


def test_intervals(spark):
    genome = spark.createDataFrame([("c1", "acgt" * 50), ("c2", "GATTACA" * 30)], "chrom string, seq string")
    iv = spark.createDataFrame([("c1", 2, 10), ("c2", 0, 7), ("c2", 205, 220)], "chrom string, start int, end int")
    got = {(r.chrom, r.start): r.seq for r in I.intervals_to_seq(iv, genome).collect()}
    assert got == {("c1", 2): "GTACGTAC", ("c2", 0): "GATTACA", ("c2", 205): "TTACA"}
    bg = I.random_intervals(genome, 20, 200)
    assert bg.count() == 200 and bg.where("start < 0").count() == 0
    q = I.interval_pwm_quantiles(iv.where("end - start = 7"), genome, scoring.collect_motifs(M.library(spark, ["SPEC"])), 0.25, 100).collect()
    assert all(0 <= r.q <= 1 for r in q)
    moved = I.centre_by_pssm(iv.limit(1), genome, identity()).first()
    assert moved.end - moved.start == 8


def test_interpolation(spark):
    x = np.linspace(0, 2 * math.pi, 100)
    df = spark.createDataFrame([(float(v),) for v in [-1, 0.3, 1.1, 5.0, 9]], "v double")
    got = [r.s for r in df.select(G.interpolated(F.col("v"), list(x), list(np.sin(x))).alias("s")).collect()]
    assert got == pytest.approx([0, *np.sin([0.3, 1.1, 5.0]), 0], abs=1e-3)


OPTIONS = G.Options(motif_length=9, spat_num_bins=3, spat_bin_size=30, kmer_lengths=(7,), max_gap=0, max_cands=2, max_steps=25)


def test_sums_and_gram():
    rng = np.random.default_rng(6)
    codes, y = rng.integers(0, 5, (60, 40)).astype(np.uint8), rng.normal(size=60)
    nuc, spat, bins = rng.dirichlet([1] * 4, 6), np.array([0.2, 0.5, 0.3]), G.bin_of(40, 13, 3, True)
    d, s = G.derivatives(codes, nuc, spat, bins, True)
    for k in range(6):
        assert (d[:, k] * nuc[k]).sum(1) == pytest.approx(s @ spat)
    table = np.column_stack([nuc, np.zeros(6)])
    direct = [sum(np.prod(t[np.arange(6), c[i : i + 6]]) * spat[bins[i]] for i in range(35) for t in (table, table[::-1][:, [3, 2, 1, 0, 4]])) for c in codes]
    assert s @ spat == pytest.approx(np.array(direct))
    e = d[:, 2] @ np.array([0.4, 0.3, 0.2, 0.1])
    one = G.r2_of(60.0, np.array([e.sum()]), np.array([(e * e).sum()]), np.array([[(e * y).sum()]]), np.array([y.sum()]), np.array([(y * y).sum()]))
    assert one[0] == pytest.approx(np.corrcoef(e, y)[0, 1] ** 2)


def test_bins():
    assert G.calculate_bins(300) == (7, 40) and G.calculate_bins(90, num_bins=3) == (3, 30)
    assert G.spatial_range(3, 90, 30) == (0, 90)
    with pytest.raises(ValueError):
        G.spatial_range(2, 90, 30)
    with pytest.raises(ValueError):
        G.calculate_bins(100, default=60) and G.spatial_range(5, 100, 33)
    assert G.moves(0.1).shape == (20, 4) and len({tuple(m) for m in G.moves(0.1).round(3)}) == 20


@pytest.fixture(scope="module")
def model(spark):
    return G.regress_pwm(planted(spark), "y", options=OPTIONS, motif_dataset=M.library(spark))


def test_regression_recovers_the_planted_motif(spark, model):
    assert "GATAAGA" in model.consensus and model.r2["y"] > 0.7 and model.ks["D"] > 0.9
    assert set(model.db_match) == {"motif", "cor"}


def test_predict_save_and_qc(spark, model, tmp_path):
    df = planted(spark)
    pred = values(model.transform(df), "pred")
    models_io.save_model(spark, model, str(tmp_path / "m"))
    assert values(models_io.load_model(spark, str(tmp_path / "m")).transform(df), "pred") == pytest.approx(pred)
    panels = plots.qc(df, model, "y")
    assert panels["prediction"].columns == ["response", "pred", "above", "d"] and panels["spatial"].count() == 3


def test_fit_in_spark_equals_fit_in_memory(spark):
    from strandlab.functions.sequence import CODES

    df = planted(spark, n=120).withColumn("seq", F.substring("seq", 1, 90))
    rows = df.orderBy("seq_id").collect()
    codes = np.array([CODES[np.frombuffer(r.seq.encode(), np.uint8)] for r in rows])
    start = G.seed_matrix("GATAAGA", 9, 0.05)
    o = G.replace(OPTIONS, max_steps=4)
    near = G.fit(G.LocalSums(codes, np.array([r.y for r in rows])), start, o, 90)
    far = G.fit(G.SparkSums(df, ["y"], 1), start, o, 90)
    assert near[0] == pytest.approx(far[0]) and near[2] == pytest.approx(far[2])


def test_multi_motif(spark, tmp_path):
    o = G.replace(OPTIONS, max_steps=6, max_cands=1)
    df = planted(spark, n=300)
    multi = G.regress_multiple_motifs(df, "y", 2, options=o)
    assert len(multi.stats) == 2 and multi.transform_multi(df).columns[-2:] == ["e1", "e2"]
    models_io.save_multi(spark, multi, str(tmp_path / "mm"))
    again = models_io.load_multi(spark, str(tmp_path / "mm"), M.library(spark))
    assert values(again.transform(df), "pred") == pytest.approx(values(multi.transform(df), "pred"))
    assert plots.qc_multi(df, multi, "y")["scores"].count() == 2


def test_stream_scores_equal_batch(spark, tmp_path):
    df = seqs(spark, ["ACGTACGTTTACG", "GGGGACGTAA", "TTTTGATAAG"])
    df.write.parquet(str(tmp_path / "in"))
    lib = scoring.collect_motifs(M.library(spark, ["SPEC", "GATA"]))
    scores = streaming.score_stream(streaming.read_sequences(spark, str(tmp_path / "in")), lib)
    streaming.write_scores(scores, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, scoring.extract_pwm(df, lib).collect()))
