"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A document is cut into pieces of ``PIECE`` bytes (all of it, so long documents
are judged as evenly as short ones). Every piece is compressed with the
dictionary built from good labelled text and with the one built from bad text;
the normalised difference of the two summed sizes, with the size that the better
dictionary leaves and the length, is mapped to a probability by a logistic
calibration fitted on labelled rows that built no dictionary.

Fitting takes at most ``per_class`` labelled documents of each class (the
smallest keyed hashes of their ids, so the choice doesn't depend on file order)
and of those only texts of up to ``MAX_FIT_BYTES`` bytes. Scoring reads every row.

Edge cases: null or empty text scores like a text of no bytes; a null id is never
held out; a table without usable labels of both classes gives 0.5 for all rows;
labels that are null are ignored; an id with several labels counts once for each,
one with several rows once; repeated rows are each scored, alike; an empty table
gives an empty result; the score replaces an input column of its name, all other
columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import crc_mod, release_memory, table

PIECE = 2048
MAX_FIT_BYTES = 20_000
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def scorer(self):
        sizes = _Sizes(self.good, self.bad)

        def score(texts) -> np.ndarray:
            x = sizes.features(texts)
            z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._compressor(d) for d in (good, bad))

    @staticmethod
    def _compressor(raw: bytes):
        words = zstandard.ZstdCompressionDict(raw)  # trained, or raw content where there were too few samples
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def features(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
            g = sum(len(self.good(p)) for p in pieces) + 1
            b = sum(len(self.bad(p)) for p in pieces) + 1
            left = min(g, b) / (len(raw) + 8)
            out[i] = (g - b) / (g + b), left, left * left, np.log1p(len(raw)), (g - b) / np.sqrt(g + b)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str], size: int) -> bytes:
    pieces = [raw[k : k + PIECE] for t in texts for raw in [t.encode("utf-8", "replace")] for k in range(0, len(raw), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: a dictionary of their raw content
        return b"".join(pieces)[-size:] or b" " * 8


def fit_compression(texts: list[str], labels: list[int], dict_bytes: int = 64 * 1024) -> CompressionModel | None:
    """Even rows build the dictionaries, odd rows calibrate."""
    by = {c: [t for t, y in zip(texts, labels) if y == c] for c in (0, 1)}
    if min(map(len, by.values())) < 2:
        return None
    # Lines that several documents share say which passages travel, not what is good or bad.
    seen = Counter(line for t in texts for line in set(t.split("\n")))
    own = {c: ["\n".join(line for line in t.split("\n") if seen[line] == 1) for t in by[c][::2]] for c in (0, 1)}
    good, bad = (_dictionary(own[c], dict_bytes) for c in (1, 0))
    rest = [(t, c) for c in (0, 1) for t in by[c][1::2]]
    x = _Sizes(good, bad).features([t for t, _ in rest])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return CompressionModel(good, bad, mean, scale, _logistic((x - mean) / scale, np.array([c for _, c in rest], float)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> list[tuple[int, str, int]]:
    """At most ``per_class`` rows (id, text, label) of each class, by the smallest hashes of their ids; of an id's texts the smallest."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)").distinct()
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * per_class ids at most: a fixed bound, so the broadcast is safe at any size.
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id").where(F.octet_length("text") <= max_bytes)
    return sorted((r.id, r.text, r.y) for r in rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000) -> CompressionModel | None:
    rows = labelled_sample(docs, labels, label, per_class, MAX_FIT_BYTES)
    return fit_compression([r[1] for r in rows], [r[2] for r in rows])


def score_quality(docs: DataFrame, model: CompressionModel | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score column (the only added one); the text alone enters it."""
    if model is None:
        return docs.withColumn(out_col, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for texts in batches:
            yield pd.Series(score(texts.tolist()))
        release_memory()

    return docs.withColumn(out_col, scored(F.col(f"`{text_col}`")))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = training_labels(table(spark, sf_dir, "labels"))
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
