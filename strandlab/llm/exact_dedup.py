"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition yields a run of (digest, smallest id, rows). Runs are
exchanged in binomial rounds: in each round ``fan_in`` neighbouring runs move to
the same reducers and are merged there, keeping the smallest identifier of each
digest, until one run is left. An exchange is hash-distributed over
(run, digest) and combines on the map side, so a digest that holds a third of
all rows costs one row per task.

Edge cases: null text counts as empty; a null id sorts after all others; rows
repeated with the same id and text are copies, of which exactly one is kept
(the first in file order); an empty table gives an empty result; other columns
of the input, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import drop_by_id, staged, table

DIGEST = ["d_sha", "d_xx", "d_len"]


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, digest): sha-256, a second hash and the length, which together verify equality."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"), F.monotonically_increasing_id().alias("rid"))
    return norm.select("rid", "id", F.unhex(F.sha2("t", 256)).alias("d_sha"), F.xxhash64("t").alias("d_xx"), F.length("t").alias("d_len"))


def merge_runs(digests: DataFrame, fan_in: int = 32) -> DataFrame:
    """One row per digest: the entry that stays and the number of rows.

    ``digests`` must be materialised: the run number is the partition part of ``rid``.
    """
    bits = max(1, fan_in.bit_length() - 1)
    last = digests.agg(F.max(F.shiftrightunsigned("rid", 33))).first()[0] or 0
    entry = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    runs = digests.select(F.shiftrightunsigned("rid", 33).alias("run"), *DIGEST, entry.alias("keep"), F.lit(1).cast("long").alias("rows"))
    while True:
        runs = runs.groupBy("run", *DIGEST).agg(F.min("keep").alias("keep"), F.sum("rows").alias("rows"))
        if last == 0:
            return runs.drop("run")
        runs = runs.withColumn("run", F.shiftrightunsigned("run", bits))
        last >>= bits


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, rid."""
    digests = staged(digest_runs(docs, id_col, text_col), "digests")
    return _grouped(digests, fan_in)


def _grouped(digests: DataFrame, fan_in: int) -> DataFrame:
    # Only digests with copies are joined back; AQE splits the one that holds many rows.
    copies = staged(merge_runs(digests, fan_in).where("rows > 1"), "classes")
    joined = digests.join(copies, DIGEST, "left")
    single = F.col("rows").isNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(single, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("d_sha")).alias("text_sha256"),
        "rid",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without an id take part like all others. Where a copy has the same id as
    the row that stays (or none), ids can't tell the two apart: then whole rows
    are written with a row number first.
    """
    gone = exact_groups(docs, id_col, text_col, fan_in).where(~F.col("kept")).select("doc_id", "keep_id")
    gone = staged(gone, "gone")
    if gone.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) | F.col("doc_id").isNull()).isEmpty():
        # An id may also belong to a second row with another text, which stays.
        several = docs.groupBy(F.col(id_col).alias("several")).agg(F.count(F.lit(1)).alias("rows_of_id")).where("rows_of_id > 1")
        if several.join(gone, F.col("several") == F.col("doc_id"), "left_semi").isEmpty():
            return drop_by_id(docs, gone.select("doc_id"), id_col)
    return _drop_rows(docs, id_col, text_col, fan_in)


def _drop_rows(docs: DataFrame, id_col: str, text_col: str, fan_in: int) -> DataFrame:
    rows = staged(docs.select(F.monotonically_increasing_id().alias("__rid"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row")), "rows")
    keyed = rows.select(F.col("__rid").alias("rid"), F.col(f"__row.`{id_col}`").alias("id"), normalised(F.col(f"__row.`{text_col}`")).alias("t"))
    digests = staged(keyed.select("rid", "id", F.unhex(F.sha2("t", 256)).alias("d_sha"), F.xxhash64("t").alias("d_xx"), F.length("t").alias("d_len")), "digests")
    gone = _grouped(digests, fan_in).where(~F.col("kept")).select(F.col("rid").alias("__rid"))
    return rows.join(gone, "__rid", "left_anti").select("__row.*")


def op5_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("rid")


# The pattern's classes are the six ASCII white space characters.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
