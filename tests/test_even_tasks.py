"""Passes of a fit read evenly dealt rows, however few partitions they come in."""

import numpy as np
from pyspark.sql import functions as F

from strandlab.operators import regression as G
from tests.test_whole_fits import random_data


def slices_of_tasks(sums):
    return sorted(r["count"] for r in sums.rows.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_one_partition_are_dealt_to_all_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(4 * cores * 1000).coalesce(1).select(F.col("id").alias("seq_id"), F.lit("ACGTTGCAGATTACAGATTACCGTATTGCATT" * 2).alias("seq"), F.col("id").cast("double").alias("y"))
    for bases in (None, df.count() * 64):
        sums = G.SparkSums(df, ["y"], 1, bases=bases)
        held = slices_of_tasks(sums)
        assert sums.tasks == len(held) == cores and held[-1] - held[0] <= 2
        request = G.Request(np.full((3, 4), 0.25), np.ones(1), np.zeros(64, int), True, "gram")
        n, total = sums(request)[:2]
        assert (n, total) == (4000 * cores, sum(range(4000 * cores)))
        sums.close()


def test_tasks_grow_with_the_bases(spark):
    df = spark.range(1)
    assert G.even_tasks(df, 0) == spark.sparkContext.defaultParallelism
    sums = G.SparkSums(spark.createDataFrame([(0, "ACGT", 1.0)], "seq_id bigint, seq string, y double"), ["y"], 1, bases=99 * G.TASK_BASES + 1)
    assert sums.tasks == 100
    sums.close()


def test_the_second_motif_is_fitted_on_as_many_cores(spark, monkeypatch):
    codes, y = random_data()
    df = spark.createDataFrame([(i, "".join("ACGT"[c] for c in row), float(v)) for i, (row, v) in enumerate(zip(codes, y))], "seq_id bigint, seq string, z double")
    seen = []
    fit = G.regress_pwm
    monkeypatch.setattr(G, "regress_pwm", lambda rows, *a, **k: seen.append(rows.rdd.getNumPartitions()) or fit(rows, *a, **k))
    G.regress_multiple_motifs(df, "z", 2, options=G.Options(motif_length=7, spat_num_bins=3, spat_bin_size=20, max_steps=1), motif="GATAA")
    assert len(seen) == 2 and seen[1] >= spark.sparkContext.defaultParallelism


def test_equal_moves_dont_depend_on_the_order_of_rows():
    """From a start without letters many moves score alike; which is made must not follow from rounding."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 4, (3000, 60)).astype(np.uint8)
    y = rng.normal(size=3000) + 0.2 * (codes == 2).sum(1)
    o = G.Options(motif_length=9, spat_num_bins=3, spat_bin_size=20, max_steps=4)
    found = []
    for seed in range(6):
        order = np.random.default_rng(seed).permutation(3000)
        trace: list = []
        sums = G.LocalSums(codes[order], y[order])
        found_steps = G.search(np.full((9, 4), 0.25), o, 60, 1, trace=trace)
        request = next(found_steps)
        try:
            while True:
                request = found_steps.send(sums(request))
        except StopIteration:
            found.append([(step, pos, move) for step, pos, move, _ in trace])
    assert all(f == found[0] for f in found)
