"""Screens and ranks score each sequence once, however often they read the scores."""

import pytest
from pyspark.sql import functions as F

from strandlab.operators import screening, stats
from strandlab.plans.scoring_queries import motifs


@pytest.fixture
def counted(spark):
    """Rows with a key that an accumulator counts whenever it is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(seq):
        seen.add(1)
        return seq

    base = spark.range(60).select(F.col("id").alias("seq_id"), F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), (F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("y"), (F.col("id") % 7).cast("double").alias("v"))
    return base.withColumn("seq", tick.asNondeterministic()("seq")), seen


def test_clusters_are_scored_once(counted):
    df, seen = counted
    assert len(screening.screen_pwm_clusters(df, "g", motifs("GATA", "SPEC"), min_D=0.0).collect()) == 6
    assert seen.value == 60


def test_enrichment_is_scored_once(counted):
    df, seen = counted
    ranks = stats.percent_ranks(df.where("seq <> ''").select("seq_id", "g", "seq", F.length("seq").cast("double").alias("v"), F.lit("m").alias("motif")).drop("seq"), "v", ["motif"])
    assert len(screening.motif_enrichment(ranks, "g", 0.9).collect()) == 3
    assert seen.value == 60


def test_ks_is_scored_once(counted):
    df, seen = counted
    assert stats.ks_distance(df.where("seq <> ''").withColumn("v", F.length("seq") + F.col("v")).withColumn("all", F.lit(0)), "v", "y", ["all"]).count() == 1
    assert seen.value == 60
