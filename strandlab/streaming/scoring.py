"""Scoring of sequence streams: the kernel is stateless, so the batch operators run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandlab.operators.scoring import Motif, extract_pwm

SCHEMA = "seq_id bigint, seq string"


def read_sequences(spark: SparkSession, path: str, format: str = "parquet", schema: str = SCHEMA, max_files: int = 16) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def score_stream(stream: DataFrame, motifs: list[Motif], **options) -> DataFrame:
    return extract_pwm(stream, motifs, **options)


def write_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to parquet, exactly once by the checkpoint, and stops when the input is used up."""
    return scores.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
