"""Synthetic example data, reproducible by seeded hashes: clustered sequences and sequences with several responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.sequence import dna_of_id

#: A word per cluster (invented).
WORDS = {"c1": "GATAAGA", "c2": "CACGTG", "c3": "TGACTCA", "c4": "CCAATCA", "c5": "TTGCGCAA"}


def _bases(n: int, length: int, spark: SparkSession) -> DataFrame:
    parts = F.concat(*(dna_of_id(F.concat_ws("/", "id", F.lit(i))) for i in range(-(-length // 64))))
    return spark.range(n).select(F.col("id").alias("seq_id"), F.substring(parts, 1, length).alias("seq"))


def clustered_sequences(spark: SparkSession, n: int = 2359, length: int = 280) -> DataFrame:
    """seq_id, seq, cluster: each cluster's word stands in the middle of most of its sequences."""
    names = F.array(*map(F.lit, WORDS))
    words = F.create_map(*(F.lit(x) for kv in WORDS.items() for x in kv))
    df = _bases(n, length, spark).withColumn("cluster", F.element_at(names, (F.pmod(F.xxhash64("seq_id"), F.lit(len(WORDS))) + 1).cast("int")))
    word = words[F.col("cluster")]
    placed = F.concat(F.substring("seq", 1, length // 2), word, F.substr("seq", F.lit(length // 2 + 1) + F.length(word), F.lit(length)))
    return df.withColumn("seq", F.when(F.pmod(F.xxhash64("seq_id", F.lit(1)), F.lit(5)) > 0, placed).otherwise(F.col("seq")))


def cluster_matrix(df: DataFrame) -> DataFrame:
    """Long 0/1 matrix: seq_id, cluster, y."""
    clusters = df.select(F.col("cluster").alias("of")).distinct()
    return df.join(F.broadcast(clusters)).select("seq_id", F.col("of").alias("cluster"), (F.col("cluster") == F.col("of")).cast("int").alias("y"))


def response_sequences(spark: SparkSession, n: int = 1000, length: int = 300) -> DataFrame:
    """seq_id, seq, c1..c5: each response follows the number of times its word occurs, with noise."""
    df = _bases(n, length, spark)
    noise = lambda i: F.pmod(F.xxhash64("seq_id", F.lit(i)), F.lit(1000)) / 1000.0
    short = {c: w[:4] for c, w in WORDS.items()}
    return df.select("seq_id", "seq", *((F.size(F.split("seq", w, -1)) - 1 + noise(i)).alias(c) for i, (c, w) in enumerate(short.items())))
