"""Scalar functions on DNA strings, as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ACGT"
#: Code of each byte: A, C, G, T are 0 to 3 in either case, all else is 4 (unknown).
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(LETTERS):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i


def rc(seq: Column) -> Column:
    """Reverse complement in upper case; other letters stay; null gives null."""
    return F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA")


def trimmed(seq: Column, start: int = 1, end: int | None = None) -> Column:
    """Positions start..end, from 1, both inclusive; ``end`` None: to the end."""
    return F.substring(seq, start, 2**31 - 1) if end is None else F.substring(seq, start, max(0, end - start + 1))


def centre_crop(seq: Column, length: int) -> Column:
    first = F.greatest(F.lit(0), F.floor((F.length(seq) - length) / 2)).cast("int")
    return F.substr(seq, first + 1, F.lit(length))


def gap_to_wildcards(kmer: Column) -> Column:
    """The first run of digits becomes as many stars: AC2GT is AC**GT."""
    digits = F.regexp_extract(kmer, r"(\d+)", 1)
    at = F.regexp_instr(kmer, F.lit(r"\d+"))
    stars = F.concat(F.substr(kmer, F.lit(1), at - 1), F.repeat(F.lit("*"), digits.cast("int")), F.substr(kmer, at + F.length(digits)))
    return F.when(digits == "", kmer).otherwise(stars)


def one_hot(seq: str) -> np.ndarray:
    """length x 4, an unknown letter is a row of NaN."""
    codes = CODES[np.frombuffer(seq.encode(), np.uint8)]
    out = np.eye(5)[codes][:, :4]
    out[codes == 4] = np.nan
    return out


def require_sequences(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Fails the job at the first missing sequence."""
    return df.withColumn(seq_col, F.when(F.col(seq_col).isNull(), F.raise_error(F.lit("There are missing values in the sequences"))).otherwise(F.col(seq_col)))


def dna_of_id(key: Column) -> Column:
    """64 bases from two hashes of a key: a stand-in where tables hold no DNA."""
    text = key.cast("string")
    return F.translate(F.concat(F.md5(text), F.md5(F.concat(text, F.lit("b")))), "0123456789abcdef", "ACGTACGTACGTACGT")


def dna_of_text(text: Column) -> Column:
    """All letters of a text as bases."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
