"""Saving and loading models as JSON, through Spark's file systems."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strandlab.operators import similarity
from strandlab.operators.regression import MotifModel, MultiModel


def export_model(model: MotifModel) -> dict:
    out = asdict(model)
    out["pssm"] = np.asarray(model.pssm).tolist()
    return out


def import_model(data: dict) -> MotifModel:
    data = dict(data)
    data["pssm"] = np.array(data["pssm"], float)
    data["spat"] = tuple(data["spat"])
    if data.get("energy_grid"):
        data["energy_grid"] = tuple(map(list, data["energy_grid"]))
    return MotifModel(**data)


def _write(spark: SparkSession, data: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_model(spark: SparkSession, model: MotifModel, path: str) -> None:
    _write(spark, export_model(model), path)


def load_model(spark: SparkSession, path: str) -> MotifModel:
    """The saved model; its predictions are those of the original, energy function included."""
    return import_model(_read(spark, path))


def save_multi(spark: SparkSession, multi: MultiModel, path: str) -> None:
    _write(spark, {"models": [export_model(m) for m in multi.models], "coefficients": np.asarray(multi.coefficients).tolist(), "responses": multi.responses, "stats": multi.stats}, path)


def load_multi(spark: SparkSession, path: str, motif_dataset: DataFrame | None = None) -> MultiModel:
    """The saved models; with a data set their nearest motifs are looked up again."""
    data = _read(spark, path)
    models = [import_model(m) for m in data["models"]]
    if motif_dataset is not None:
        for m, s in zip(models, data["stats"]):
            hit = similarity.pssm_match(m.table(spark), motif_dataset).first()
            m.db_match = {"motif": hit.motif, "cor": hit.cor}
            s.update(db_match=hit.motif, db_match_cor=hit.cor)
    return MultiModel(models, np.array(data["coefficients"], float), data["responses"], data["stats"])
