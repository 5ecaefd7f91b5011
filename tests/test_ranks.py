"""Ranks over cells, running sums and what is built on them, against plain Python."""

import bisect
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.operators import intervals as I
from strandlab.operators import ranks, sampling, stats
from strandlab.operators import regression as G
from tests.test_functions import planted


@pytest.mark.parametrize("buckets, block", [(1, 1000), (10, 100), (10, 7), (40, 130)])
def test_running_mean_with_small_ranges_and_ties(spark, buckets, block):
    rng = random.Random(1)
    rows = [(i, rng.choice([5.0, 5.0, rng.random() * 10]), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "seq_id bigint, x double, v double").repartition(3)
    got = {r.seq_id: r.smooth for r in stats.running_mean(df, "x", "v", 100, buckets=buckets, block=block).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {r[0]: np.mean([s[2] for s in order[max(0, i - 49) : i + 51]]) for i, r in enumerate(order)}
    assert got == pytest.approx(want)


def test_ranks_in_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(-50, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id bigint, g string, v int")
    got = ranks.ranked(df, ["g"], F.floor(F.col("v") / 9), ["v", "seq_id"], "k", "n").collect()
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert {r.seq_id: (r.k, r.n) for r in got if r.g == g} == {r[0]: (i, len(order)) for i, r in enumerate(order)}
    assert ranks.ranked(df.limit(0), ["g"], F.col("v"), ["v"], "k", "n").count() == 0


def test_ks_and_percent_ranks_over_cells(spark):
    rng = random.Random(3)
    rows = [(i, m, round(rng.gauss(-8, 2), 2), rng.randint(0, 1)) for i in range(400) for m in ("p", "q")]
    df = spark.createDataFrame(rows, "seq_id bigint, motif string, v double, y int")
    for alternative in stats.ALTERNATIVES:
        got = {r.motif: r.D for r in stats.ks_distance(df, "v", "y", ["motif"], alternative, cell=0.7).collect()}
        for m in got:
            one, zero = (sorted(r[2] for r in rows if r[1] == m and r[3] == c) for c in (1, 0))
            gaps = [bisect.bisect_right(one, x) / len(one) - bisect.bisect_right(zero, x) / len(zero) for x in one + zero]
            assert got[m] == pytest.approx({"two.sided": max(map(abs, gaps)), "greater": max(gaps), "less": max(-g for g in gaps)}[alternative])
    ranked = {(r.seq_id, r.motif): r.q for r in stats.percent_ranks(df, "v", ["motif"], cell=0.7).collect()}
    values = {m: sorted(r[2] for r in rows if r[1] == m) for m in ("p", "q")}
    assert ranked == pytest.approx({(r[0], r[1]): bisect.bisect_left(values[r[1]], r[2]) / 399 for r in rows})


def test_folds_are_even_and_shuffled(spark):
    df = spark.range(103).select(F.col("id").alias("seq_id"), (F.col("id") % 2).alias("y"))
    for compat in (False, True):
        sizes = [r["count"] for r in sampling.cv_folds(df, 5, compat=compat).groupBy("fold").count().orderBy("fold").collect()]
        assert sizes == [21, 21, 21, 20, 20]
    blocks = [r.fold for r in sampling.cv_folds(df, 5, compat=True).orderBy("seq_id").collect()]
    assert blocks == sorted(blocks)
    assert sorted(r.fold for r in sampling.cv_folds(df.limit(2), 5).collect()) == [1, 2]


def test_genome_in_tiles_and_fasta(spark, tmp_path):
    rng = random.Random(4)
    chroms = {c: "".join(rng.choices("acgtN", k=n)) for c, n in (("c1", 1000), ("c2", 63), ("c3", 64))}
    path = tmp_path / "g.fa"
    path.write_text("".join(f">{c} some words\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n" for c, s in chroms.items()))
    genome = I.Genome.fasta(spark, str(path), size=64)
    assert {r.chrom: r.length for r in genome.lengths().collect()} == {c: len(s) for c, s in chroms.items()}
    assert genome.tiles.where("length(seq) > 64 or at % 64 <> 0").count() == 0
    rows = [(c, s, s + n) for c in [*chroms, "none"] for s, n in ((-5, 20), (0, 64), (10, 0), (60, 10), (63, 300), (990, 50), (5000, 9))]
    df = spark.createDataFrame(rows * 2, "chrom string, start int, end int")
    got = sorted((r.chrom, r.start, r.end, r.seq) for r in I.intervals_to_seq(df, genome).collect())
    assert got == sorted((c, s, e, chroms[c][max(0, s) : max(0, e)].upper()) for c, s, e in rows * 2 if c in chroms)
    mixed = spark.createDataFrame([("c1", 0, 20), ("c1", 5, 45)], "chrom string, start int, end int")
    sizes = I.random_intervals(genome, mixed.select((F.col("end") - F.col("start")).alias("size")), 100)
    assert {r.n: r["count"] for r in sizes.groupBy((F.col("end") - F.col("start")).alias("n")).count().collect()} == {20: 100, 40: 100}


def test_sums_are_added_on_executors(spark, monkeypatch):
    df = planted(spark).repartition(11)
    request = G.Request(np.full((3, 4), 0.25), np.ones(1), np.zeros(5000, int), True, "gram")
    sums = G.SparkSums(df, ["y"], 1)
    plain = sums(request)
    monkeypatch.setattr(G.SparkSums, "FAN", 2)
    assert sums(request) == pytest.approx(plain)
    sums.close()


def test_folds_and_samples_of_the_caller(spark, monkeypatch):
    """What is fitted on: the caller's rows."""
    df = spark.range(10).select(F.col("id").alias("seq_id"), F.lit("ACGT").alias("seq"), (F.col("id") % 2).cast("int").alias("y"))
    fitted = []
    model = G.MotifModel(np.full((2, 4), 0.25), (1.0,), 4, 0, 4)

    def together(d, parts, names, options=None, *a):
        fitted.extend(sorted(r.seq_id for r in d.where(F.col("__parts").bitwiseAND(F.lit(1 << k)) != 0).collect()) for k in range(parts))
        return [model] * parts

    monkeypatch.setattr(G, "regress_together", together)
    monkeypatch.setattr(G, "scored", lambda d, m, *a: m)
    folds = spark.createDataFrame([(i, 7 if i < 4 else 9) for i in range(8)], "seq_id bigint, fold int")
    out = G.regress_pwm_cv(df, "y", folds=folds, add_full_model=False)
    assert fitted == [[4, 5, 6, 7], [0, 1, 2, 3]] and out["predictions"].count() == 8
    G.regress_pwm_sample(df, "y", sample_ids=folds.where("fold = 9").select("seq_id"))
    assert fitted[-1] == [4, 5, 6, 7]


@pytest.mark.parametrize("bins, ordered", [(1024, 65_536), (64, 20), (4096, 0)])
def test_quantiles_by_narrowing(spark, bins, ordered):
    rng = random.Random(5)
    draw = {"wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 3), "ties": lambda: float(rng.randint(0, 3)), "even": rng.random, "huge": lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324])}
    rows = [(g, f()) for g, f in draw.items() for _ in range(120)] + [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: r.quantiles for r in stats.quantiles(df, "v", probs, ["g"], bins=bins, ordered=ordered).collect()}
    assert got.pop("none") is None and set(got) == {*draw, "one", None}
    for g, q in got.items():
        own = sorted(v for h, v in rows if h == g and v is not None)
        want = [own[math.floor(h)] + (own[math.ceil(h)] - own[math.floor(h)]) * (h - math.floor(h)) for h in ((len(own) - 1) * p for p in probs)]
        assert q == pytest.approx(want)
    whole = stats.quantiles(df.where("g = 'even'"), "v", [0.5], [], bins=bins, ordered=ordered).collect()
    assert len(whole) == 1 and whole[0].quantiles == pytest.approx([np.quantile([v for g, v in rows if g == "even"], 0.5)])
    assert [r.quantiles for r in stats.quantiles(df.limit(0), "v", [0.5], []).collect()] == []


def test_running_mean_splits_one_value(spark):
    """A third of all rows share one order value: ranges are even all the same, and the plan is as long for many ranges as for few."""
    rows = [(i, 1.0 if i % 3 == 0 else float(i), float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq_id bigint, x double, v double").repartition(7)
    sizes = df.repartitionByRange(10, "x", "seq_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 600
    plans = []
    for buckets in (2, 60):
        out = stats.running_mean(df, "x", "v", 10, buckets=buckets, block=100)
        plans.append(len(out._jdf.queryExecution().analyzed().toString().split("\n")))
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        want = {r[0]: np.mean([s[2] for s in order[max(0, i - 4) : i + 6]]) for i, r in enumerate(order)}
        assert {r.seq_id: r.smooth for r in out.collect()} == pytest.approx(want)
    assert plans[0] == plans[1]


@pytest.mark.parametrize("n1, n0", [(1, 1), (2, 3), (4, 5), (3, 6)])
def test_exact_ks_p_values_equal_enumeration(n1, n0):
    rng = random.Random(n1 * 10 + n0)
    for values in (list(range(n1 + n0)), sorted(rng.randint(0, 3) for _ in range(n1 + n0))):
        ties = [values.count(v) for v in sorted(set(values))]

        def distance(ones, alternative):
            one, zero = ([values[i] for i in range(n1 + n0) if (i in ones) == c] for c in (True, False))
            gaps = [bisect.bisect_right(one, x) / n1 - bisect.bisect_right(zero, x) / n0 for x in set(values)]
            return {"two.sided": max(map(abs, gaps)), "greater": max(gaps), "less": max(-g for g in gaps)}[alternative]

        for alternative in stats.ALTERNATIVES:
            every = [distance(set(c), alternative) for c in itertools.combinations(range(n1 + n0), n1)]
            for d in set(every):
                want = sum(e >= d - 1e-9 for e in every) / len(every)
                assert stats.ks_p_value(d, n1, n0, alternative, ties) == pytest.approx(want), (values, alternative, d)
    large = stats.ks_p_value(0.15, 99, 100)
    assert large == pytest.approx(stats.ks_p_value(0.15, 100, 101), rel=0.3)  # the asymptotic one beside it
