"""Token counts as an exact histogram of encoded lengths.

Each text is encoded once; texts are then aggregated by length (partial sums
before the shuffle, so a length that many copies share costs one row per task).
Suffix sums over the histogram answer totals, quantiles and truncated totals for
every context limit without touching a text again.

The vocabulary file (public byte-level BPE ranks) is a parameter, read on the
driver and broadcast (0.8 MB). Without a file, lengths are UTF-8 bytes.

Runs of ``LONG_SPACE`` white spaces or more, on which the encoder's regular
expression fails, are encoded on their own: the pattern always cuts such a run
before its last character (at the end of the text: after it), so the count is
the encoder's.

Edge cases: null and empty texts have length 0 and count as documents; repeated
rows count each; an empty table gives an empty histogram; strings of special
tokens in a text are ordinary text; an input column of the name of the count is
replaced by it, all others are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm._common import release_memory, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = 1000
#: Unicode's white space (fixed value).
_long_space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
_encoders: dict = {}


def _encoder(raw: bytes):
    """One encoder per worker process."""
    if raw not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, raw.splitlines())}
        _encoders[raw] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[raw]


def token_count(encoder, text: str) -> int:
    n = at = 0
    for m in _long_space.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoder.encode_ordinary(text[at:]))


def with_token_counts(docs: DataFrame, vocabulary: str | None = VOCABULARY, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the encoded length of each whole text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    if vocabulary is None:
        return docs.withColumn(out_col, F.octet_length(text).cast("bigint"))
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared.value)
        for texts in batches:
            yield pd.Series([token_count(encoder, t) for t in texts], dtype="int64")
        release_memory()

    return docs.withColumn(out_col, count(text))


def length_histogram(counted: DataFrame, count_col: str = "n_tokens") -> DataFrame:
    return counted.groupBy(F.col(count_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each occurring length as the limit: documents, totals, quantile rank and truncated totals.

    The windows run over the histogram, whose size is the number of distinct
    lengths and doesn't follow the number of documents.
    """
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("docs") * F.col("n_tokens")
    sums = histogram.select(
        F.col("n_tokens").alias("context_limit"),
        "docs",
        F.sum("docs").over(up).alias("docs_within"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_cut"),
        F.sum(mass).over(up).alias("tokens_within"),
        F.coalesce(F.sum(mass).over(after), F.lit(0)).alias("tokens_of_longer"),
    )
    kept = F.col("tokens_within") + F.col("docs_cut") * F.col("context_limit")
    return sums.select(
        "context_limit",
        "docs",
        "docs_within",
        "docs_cut",
        (F.col("docs_within") / (F.col("docs_within") + F.col("docs_cut"))).alias("quantile"),
        (F.col("tokens_within") + F.col("tokens_of_longer")).alias("tokens_total"),
        kept.alias("tokens_truncated"),
        (F.col("tokens_of_longer") - F.col("docs_cut") * F.col("context_limit")).alias("tokens_lost"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Totals for any one limit, whether or not it occurs as a length."""
    return histogram.agg(
        F.lit(limit).cast("bigint").alias("context_limit"),
        F.coalesce(F.sum(F.col("docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).cast("bigint").alias("tokens_truncated"),
        F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).cast("bigint").alias("tokens_total"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).cast("bigint").alias("docs_cut"),
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents does not exceed."""
    return context_limits(histogram).where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return context_limits(length_histogram(with_token_counts(docs)))
