"""From raw documents to packed batches: quality, exact copies, near copies, leaks, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame; stages but the last return the columns of ``documents``.
Every stage is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm import decontam, exact_dedup, neardup, packing, quality
from strandlab.llm._common import drop_by_id, drop_numbered, ids_are_unique, numbered, staged, table

KEEP_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under ``KEEP_QUALITY``; the model is fitted on the labelled rows that aren't held out.

    Null text scores like empty text; a null id only means that the row isn't
    fitted on; repeated rows score alike; without labels of both classes all rows
    stay; an empty table stays empty; all columns, whatever their names, are kept.
    """
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    if model is None:  # no labels to fit on: nothing is known against any document
        return docs
    rows = docs.select("text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return quality.score_quality(rows, model).where(F.col("score") >= KEEP_QUALITY).select("row.*")


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the row with the smallest id stays.

    Null text counts as empty; null ids come after all others; of rows with the
    same text and id the first in file order stays; an empty table stays empty;
    all columns are kept.
    """
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays.

    Texts without words are one class; null ids come after all others, ties go to
    the first row; an empty table stays empty; all columns are kept.
    """
    return neardup.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item leaks, whatever their ids.

    Null and empty texts stay; repeated rows are decided alike; without items or
    documents nothing changes; all columns are kept.
    """
    items = table(spark, sf_dir, "benchmark")
    if ids_are_unique(docs):
        leaks = decontam.contaminated(docs.select("doc_id", "text"), items)
        return drop_by_id(docs, staged(leaks.select("doc_id").distinct(), "leaks"))
    rows = numbered(docs)
    leaks = decontam.contaminated(rows.select("__rid", "__row.text"), items, id_col="__rid")
    return drop_numbered(rows, staged(leaks.select("doc_id").distinct(), "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot.

    Null and empty texts have length 0 and are placed; every row, repeated or
    without id, gets a place of its own; an empty table stays empty; only doc_id
    of the input's columns is carried on.
    """
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


#: Compression, signatures and encoding have no SQL form; the tests compare with brute force.
ORACLE_SQL = None
