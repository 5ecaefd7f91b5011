"""Packing into optimal length buckets with token-budget batches.

The global histogram of encoded lengths is small whatever the corpus (one row per
distinct length); dynamic programming over it picks the bucket boundaries with
the least padding. A batch holds as many documents of one bucket as the token
budget allows at the bucket's upper length (one, where a document alone exceeds
it). Documents of a bucket are ordered by length, then by a hash of their row,
and numbered without gathering the bucket: counts of (length, hash cell) give
each cell its offset, row numbers exist only within a cell. The number of cells
follows the number of documents, so a length that a third of them share is spread.

Every document gets exactly one place; nothing is cut. Edge cases: null and
empty texts have length 0 and are placed too; ties and repeated rows get places
of their own; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm._common import staged, table
from strandlab.llm.tokens import VOCABULARY, with_token_counts

CELL_DOCS = 20_000  # documents a cell may hold, about, where all have one length


def best_boundaries(lengths, counts, buckets: int) -> tuple[list[int], int]:
    """Upper lengths of the buckets and their total padding, the least that ``buckets`` buckets allow.

    The padding of a range satisfies the quadrangle inequality, so the best split
    moves monotonically and each layer takes O(n log n).
    """
    order = np.argsort(np.asarray(lengths, np.int64), kind="stable")
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return [], 0
    docs = np.concatenate([[0], np.cumsum(c)])
    mass = np.concatenate([[0], np.cumsum(c * x)])
    best = x * docs[1:] - mass[1:]  # one bucket up to j
    cuts = []
    for _ in range(min(buckets, n) - 1):
        nxt, cut = best.copy(), np.full(n, -1, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)  # the last length of the bucket before
            at = a
            if len(i):
                cost = best[i] + x[j] * (docs[j + 1] - docs[i + 1]) - (mass[j + 1] - mass[i + 1])
                k = int(cost.argmin())
                at = int(i[k])
                if cost[k] < nxt[j]:
                    nxt[j], cut[j] = cost[k], at
            todo += [(lo, j - 1, a, at), (j + 1, hi, at, b)]
        cuts.append(cut)
        best = nxt
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(x[j]))
            j = int(cut[j])
    bounds.append(int(x[j]))
    return bounds[::-1], int(best[-1])


def packed(docs: DataFrame, vocabulary: str | None = VOCABULARY, buckets: int = 16, token_budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_length, batch, slot, batch_size, padding."""
    counted = with_token_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocabulary)
    rid = F.monotonically_increasing_id()
    lengths = staged(counted.select("doc_id", "n_tokens", rid.alias("rid")), "lengths")
    number_of_cells = max(16, lengths.count() // CELL_DOCS)
    lengths = lengths.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(number_of_cells)))
    cells = staged(lengths.groupBy("n_tokens", "cell").agg(F.count(F.lit(1)).alias("docs")), "cells")
    rows = cells.groupBy("n_tokens").agg(F.sum("docs").alias("docs")).collect()  # one per distinct length
    bounds, _ = best_boundaries([r.n_tokens for r in rows], [r.docs for r in rows], buckets)

    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    upper = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds or [0]]), F.col("bucket") + 1)
    by_length = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    of_length = cells.groupBy("n_tokens").agg(F.sum("docs").alias("all_docs")).withColumn("bucket", bucket)
    of_length = of_length.select("n_tokens", F.coalesce(F.sum("all_docs").over(by_length), F.lit(0)).alias("before"), F.sum("all_docs").over(Window.partitionBy("bucket")).alias("bucket_docs"))
    by_cell = Window.partitionBy("n_tokens").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("inside", F.coalesce(F.sum("docs").over(by_cell), F.lit(0))).join(of_length, "n_tokens")
    offsets = offsets.select("n_tokens", "cell", (F.col("before") + F.col("inside")).alias("start"), "bucket_docs")

    number = F.row_number().over(Window.partitionBy("n_tokens", "cell").orderBy("rid"))
    placed = lengths.withColumn("number", number).join(offsets, ["n_tokens", "cell"]).withColumn("bucket", bucket).withColumn("bucket_length", upper)
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("bigint")
    rank = F.col("start") + F.col("number") - 1
    return placed.withColumn("size", size).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(rank / F.col("size")).alias("batch"),
        (rank % F.col("size")).alias("slot"),
        F.least(F.col("size"), F.col("bucket_docs") - F.floor(rank / F.col("size")) * F.col("size")).alias("batch_size"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
