"""Data behind the plots, as tidy tables; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.functions import pssm as P
from strandlab.operators.regression import MotifModel, MultiModel
from strandlab.operators.stats import ks_distance


def logo(df: DataFrame, method: str = "bits", reverse: bool = False, pos_bits_thresh: float | None = None) -> DataFrame:
    """Letter heights; positions under the threshold are left out."""
    df = P.reverse_complement(df) if reverse else df
    out = P.letter_heights(df, method=method)
    if pos_bits_thresh is not None:
        out = out.join(P.bits_per_pos(df).where(F.col("bits") > pos_bits_thresh).select("motif", "pos"), ["motif", "pos"], "left_semi")
    return out


def spatial_model(spark: SparkSession, model: MotifModel) -> DataFrame:
    return model.spatial_table(spark)


def prediction_scatter(df: DataFrame, pred: str, response: str) -> DataFrame:
    return df.select(F.col(pred).alias("pred"), F.col(response).cast("double").alias("response"))


def prediction_curves(df: DataFrame, pred: str, response: str) -> DataFrame:
    """1 - ECDF of the prediction for both classes: response, pred, above; with the KS distance d."""
    counts = df.groupBy(F.col(response).alias("response"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("response").orderBy("pred").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curves = counts.select("response", "pred", (1 - F.sum("n").over(up) / F.sum("n").over(Window.partitionBy("response"))).alias("above"))
    d = ks_distance(df.withColumn("__all", F.lit(0)), pred, response, ["__all"]).select(F.col("D").alias("d"))
    return curves.crossJoin(F.broadcast(d))


def qc(df: DataFrame, model: MotifModel, response: str) -> dict[str, DataFrame]:
    """All panels of a single model: logo, spatial model, prediction."""
    spark = df.sparkSession
    pred = model.transform(df)
    binary = df.where(~F.col(response).isin(0, 1)).limit(1).count() == 0
    return {"logo": logo(model.table(spark)), "spatial": spatial_model(spark, model), "prediction": prediction_curves(pred, "pred", response) if binary else prediction_scatter(pred, "pred", response)}


def qc_multi(df: DataFrame, multi: MultiModel, response: str) -> dict:
    """Panels of each model and the table of scores."""
    schema = "model int, score double, comb_score double, diff double, consensus string, seed_motif string"
    keys = ["model", "score", "comb_score", "diff", "consensus", "seed_motif"]
    return {"models": [qc(df, m, response) for m in multi.models], "scores": df.sparkSession.createDataFrame([tuple(s.get(k) for k in keys) for s in multi.stats], schema)}
