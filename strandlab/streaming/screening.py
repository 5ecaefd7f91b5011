"""Screening of a stream: sums are kept in the state store, one row for each motif, and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from strandlab.operators.scoring import Motif, extract_pwm
from strandlab.operators.stats import r_squared


def screen_stream(stream: DataFrame, response: str | list[str], motifs: list[Motif], **options) -> DataFrame:
    """motif, score, n: r squared of all rows so far, as ``screen_pwm`` gives for them at once, whatever the batches.

    Several responses are averaged per sequence. Rows without a score or a response don't count.
    """
    names = [response] if isinstance(response, str) else response
    y = sum((F.col(c).cast("double") for c in names[1:]), F.col(names[0]).cast("double")) / len(names)
    scores = extract_pwm(stream.select("seq_id", "seq", y.alias("y")), motifs, id_cols=["seq_id", "y"], **options)
    return scores.groupBy("motif").agg(r_squared(F.col("pwm"), F.col("y")).alias("score"), F.count(F.col("pwm") + F.col("y")).alias("n"))


def write_screen(screen: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replaces the table at ``path`` after every batch and stops when the input is used up; a batch that runs again writes the same table."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return screen.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
