"""Motif libraries as tidy tables: (motif, pos, A, C, G, T[, dataset, motif_orig])."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "motif string, pos int, A double, C double, G double, T double"
LETTERS = ["A", "C", "G", "T"]

#: A small synthetic library: name, dataset, and per position the weights of A, C, G, T.
LIBRARY: dict[str, tuple[str, list[tuple[float, float, float, float]]]] = {
    "GATA": ("SYN1", [(0.1, 0.1, 0.7, 0.1), (0.85, 0.05, 0.05, 0.05), (0.04, 0.03, 0.03, 0.9), (0.8, 0.05, 0.05, 0.1), (0.7, 0.1, 0.1, 0.1), (0.3, 0.2, 0.4, 0.1)]),
    "EBOX": ("SYN1", [(0.05, 0.85, 0.05, 0.05), (0.9, 0.04, 0.03, 0.03), (0.1, 0.4, 0.4, 0.1), (0.1, 0.4, 0.4, 0.1), (0.03, 0.03, 0.04, 0.9), (0.05, 0.05, 0.85, 0.05)]),
    "TATA": ("SYN2", [(0.02, 0.02, 0.02, 0.94), (0.94, 0.02, 0.02, 0.02), (0.02, 0.02, 0.02, 0.94), (0.9, 0.02, 0.02, 0.06), (0.6, 0.05, 0.05, 0.3), (0.88, 0.04, 0.04, 0.04), (0.5, 0.05, 0.1, 0.35), (0.3, 0.2, 0.35, 0.15)]),
    "WEAK": ("SYN2", [(0.25, 0.25, 0.25, 0.25), (0.4, 0.2, 0.2, 0.2), (0.1, 0.6, 0.2, 0.1), (0.2, 0.2, 0.5, 0.1), (0.27, 0.23, 0.25, 0.25)]),
    "SPEC": ("SYN2", [(0.97, 0.01, 0.01, 0.01), (0.01, 0.97, 0.01, 0.01), (0.01, 0.01, 0.97, 0.01), (0.01, 0.01, 0.01, 0.97)]),
}


def rows(names: list[str] | None = None) -> list[tuple]:
    return [(name, pos, *p) for name, (_, matrix) in LIBRARY.items() if names is None or name in names for pos, p in enumerate(matrix)]


def library(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame(rows(names), SCHEMA)


def values_sql(names: list[str] | None = None) -> str:
    """The same library as a SQL table ``m(motif, pos, A, C, G, T)``."""
    body = ", ".join(f"('{r[0]}', {r[1]}, " + ", ".join(f"CAST({x} AS DOUBLE)" for x in r[2:]) + ")" for r in rows(names))
    return f"m(motif, pos, A, C, G, T) AS (VALUES {body})"


def datasets(spark: SparkSession) -> dict[str, DataFrame]:
    """The library by data set, as separate sources would deliver it."""
    return {d: library(spark, [n for n, (x, _) in LIBRARY.items() if x == d]) for d in sorted({x for x, _ in LIBRARY.values()})}


def all_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of data sets; names become ``dataset.motif``, the plain name stays in ``motif_orig``."""
    tagged = [df.select(F.concat_ws(".", F.lit(name), "motif").alias("motif"), "pos", *LETTERS, F.lit(name).alias("dataset"), F.col("motif").alias("motif_orig")) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def motif_pssm(dataset: DataFrame, motif: str) -> DataFrame:
    """One motif by its exact name."""
    return dataset.where(F.col("motif") == motif).select("pos", *LETTERS)


def read_motifs(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A tidy motif table from parquet, CSV, JSON or ORC with the fixed schema."""
    return spark.read.format(format).schema(SCHEMA).options(**options).load(path)


def read_jaspar(spark: SparkSession, path: str) -> DataFrame:
    """JASPAR position frequency files: ``>id name`` and four rows ``A [ 1 2 3 ]``.

    Rows are divided by their sums, positions start at 0, a name that occurs for
    several ids becomes ``name.id``.
    """
    entry = F.explode(F.filter(F.split("value", r"(?m)^>"), lambda e: F.trim(e) != ""))
    entries = spark.read.text(path, wholetext=True).select(entry.alias("e"))
    head = F.split(F.trim(F.regexp_extract("e", r"^([^\r\n]*)", 1)), r"\s+")
    counts = lambda c: F.transform(F.split(F.trim(F.regexp_extract("e", rf"(?m)^\s*{c}\s*\[([^\]]*)\]", 1)), r"\s+"), lambda x: x.cast("double"))
    parsed = entries.select(F.get(head, F.lit(0)).alias("id"), F.coalesce(F.get(head, F.lit(1)), F.get(head, F.lit(0))).alias("name"), F.arrays_zip(*(counts(c).alias(c) for c in LETTERS)).alias("z"))
    ids = F.count(F.lit(1)).over(Window.partitionBy("name"))
    named = parsed.withColumn("motif", F.when(ids > 1, F.concat_ws(".", "name", "id")).otherwise(F.col("name")))
    long = named.select("motif", F.posexplode("z").alias("pos", "v"))
    total = sum((F.col(f"v.{c}") for c in LETTERS[1:]), F.col("v.A"))
    return long.select("motif", "pos", *((F.col(f"v.{c}") / total).alias(c) for c in LETTERS))
