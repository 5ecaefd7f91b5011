"""Ranking motifs against responses and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlab.operators.scoring import Motif, extract_pwm
from strandlab.operators.ranks import running
from strandlab.operators.session import checkpointed
from strandlab.operators.stats import cells, ks_distance, r_squared


def screen_pwm(df: DataFrame, response: str | list[str], motifs: list[Motif], metric: str | None = None, alternative: str = "two.sided", only_best: bool = False, **options) -> DataFrame:
    """motif, score: r squared, or the KS distance for a 0/1 response; best first.

    Several responses are averaged per sequence. ``metric`` None decides by the
    response's values.
    """
    names = [response] if isinstance(response, str) else response
    y = sum((F.col(c).cast("double") for c in names[1:]), F.col(names[0]).cast("double")) / len(names)
    data = df.select("seq_id", "seq", y.alias("y"))
    if metric is None:
        metric = "r2" if data.where("y not in (0, 1)").limit(1).count() else "ks"
    scores = extract_pwm(data, motifs, id_cols=["seq_id", "y"], **options)
    if metric == "ks":
        out = ks_distance(scores, "pwm", "y", ["motif"], alternative).select("motif", F.col("D").alias("score"))
    else:
        out = scores.groupBy("motif").agg(r_squared(F.col("pwm"), F.col("y")).alias("score"))
    out = out.orderBy(F.desc("score"), "motif")
    return out.limit(1) if only_best else out


def screen_pwm_clusters(df: DataFrame, cluster: str, motifs: list[Motif], min_D: float = 0.4, alternative: str = "two.sided", only_best: bool = False, **options) -> DataFrame:
    """motif, cluster, D of each cluster against the rest; motifs whose best D reaches ``min_D``.

    One pass over values serves all clusters: counts by (motif, value, cluster) and
    totals by (motif, value) give every one-against-rest distribution. Running sums
    go over cells of value first, so no task holds all rows of a motif. A null
    cluster belongs to the rest of every other.
    """
    scores = extract_pwm(df, motifs, id_cols=["seq_id", cluster], **options).where(F.col("pwm").isNotNull())
    counts = checkpointed(scores.groupBy("motif", "pwm", F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("c1")))  # read four times, scored once
    totals = counts.groupBy("motif", "pwm").agg(F.sum("c1").alias("all"))
    totals = running(totals, ["motif"], "pwm", cells("pwm"), {"all": ("run_all", "n_all")})
    steps = running(counts, ["motif", "cluster"], "pwm", cells("pwm"), {"c1": ("r1", "n1")}).join(totals, ["motif", "pwm"])

    def gap(r1, run_all):
        return r1 / F.col("n1") - (run_all - r1) / F.nullif(F.col("n_all") - F.col("n1"), F.lit(0))

    # Between two values of the cluster the rest only rises: the gap peaks at the cluster's values, and is lowest just before them.
    high = gap(F.col("r1"), F.col("run_all"))
    low = gap(F.col("r1") - F.col("c1"), F.col("run_all") - F.col("all"))
    best = {"two.sided": F.greatest(F.abs(high), F.abs(low)), "greater": F.greatest(high, F.lit(0.0)), "less": F.greatest(-low, F.lit(0.0))}[alternative]
    out = steps.groupBy("motif", "cluster").agg(F.max(best).alias("D"))
    strong = out.withColumn("__top", F.max("D").over(Window.partitionBy("motif"))).where(F.col("__top") >= min_D).drop("__top")
    if only_best:
        return strong.groupBy("cluster").agg(F.max_by("motif", F.struct("D", "motif")).alias("motif"), F.max("D").alias("D"))
    return strong


def motif_enrichment(quantiles: DataFrame, group: str, threshold: float = 0.99, kind: str = "relative") -> DataFrame:
    """motif, group, hits, n, enrichment from long (seq, group, motif, q); relative to the other groups, or to 1 - threshold."""
    if kind not in ("relative", "absolute"):
        raise ValueError("kind must be relative or absolute")
    hit = (F.col("q") >= threshold).cast("bigint")
    per = quantiles.groupBy(F.col(group).alias("group"), "motif").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("motif")
    per = per.withColumn("all_hits", F.sum("hits").over(whole)).withColumn("all_n", F.sum("n").over(whole))
    if kind == "relative":
        value = F.try_divide(F.col("hits") / F.col("n"), F.try_divide(F.col("all_hits") - F.col("hits"), F.col("all_n") - F.col("n")))
    else:
        value = F.col("hits") / F.col("n") / F.lit(1 - threshold)
    return per.select("group", "motif", "hits", "n", value.alias("enrichment"))
