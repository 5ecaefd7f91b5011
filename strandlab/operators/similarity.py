"""Similarity of motifs: correlation or symmetric KL divergence at the best offset.

The shorter matrix slides over the longer one (full overlap, same strand); rows
carry the prior. Motifs are dealt into blocks of about ``BLOCK``; blocks meet in
pairs (of one data set each two blocks once), and all scores of a pair of blocks
at one offset come from one matrix product over standardised windows, whose ranks
and norms are computed once for each window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import pssm as P

METHODS = ("spearman", "pearson", "kl")


def average_ranks(x: np.ndarray) -> np.ndarray:
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[inverse]


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks within each row, values equal within 1e-12."""
    x = np.round(x, 12)
    out = np.empty_like(x)
    step = max(1, 4_000_000 // x.shape[1] ** 2)
    for k in range(0, len(x), step):
        part = x[k : k + step]
        below = (part[:, None, :] < part[:, :, None]).sum(axis=2)
        equal = (part[:, None, :] == part[:, :, None]).sum(axis=2)
        out[k : k + step] = below + (equal + 1) / 2
    return out


def _standard(x: np.ndarray, method: str) -> np.ndarray:
    """Rows (their ranks for spearman) centred and of norm 1; NaN where a row doesn't vary."""
    x = _ranks(x) if method == "spearman" else x
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def block_scores(left: list[np.ndarray], right: list[np.ndarray], method: str) -> np.ndarray:
    """left x right: the best score over all offsets; each motif is a flat array of 4 numbers a position."""
    out = np.full((len(left), len(right)), np.nan)
    by_length = [{n: np.flatnonzero(np.array([len(m) for m in side]) == n) for n in {len(m) for m in side}} for side in (left, right)]
    for n, at in by_length[0].items():
        for m, to in by_length[1].items():
            x, y = np.stack([left[i] for i in at]), np.stack([right[j] for j in to])
            best = _best(x, y, method) if n <= m else _best(y, x, method).T
            out[np.ix_(at, to)] = best
    return out


def _best(x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """``x``: motifs of one length, ``y``: of one length at least as long."""
    best = np.full((len(x), len(y)), np.nan)
    fixed = None if method == "kl" else _standard(x, method)
    for k in range(0, y.shape[1] - x.shape[1] + 1, 4):
        window = y[:, k : k + x.shape[1]]
        if method == "kl":
            with np.errstate(divide="ignore", invalid="ignore"):
                lx, ly = np.log(x), np.log(window)
                score = ((x * lx).sum(axis=1)[:, None] + (window * ly).sum(axis=1)[None] - x @ ly.T - lx @ window.T) / 2
            best = np.fmin(best, score)
        else:
            best = np.fmax(best, fixed @ _standard(window, method).T)
    return best


def _flat(df: DataFrame, name: str, prior: float) -> DataFrame:
    p = P.with_prior(df, prior, normalise_first=True)
    rows = p.groupBy(F.col("motif").alias(name)).agg(F.array_sort(F.collect_list(F.struct("pos", F.array(*P.LETTERS).alias("v")))).alias("r"))
    return rows.select(name, F.flatten(F.transform("r", lambda x: x["v"])).alias(f"p_{name}"))


#: Motifs of a block.
BLOCK = 256


def _in_blocks(left: DataFrame, right: DataFrame, method: str, triangle: bool) -> DataFrame:
    """motif1, motif2, score: every pair of the two tables; ``triangle``: of one table each two motifs once, by name."""
    if method not in METHODS:
        raise ValueError("method must be spearman, pearson or kl")
    across, down = (max(1, -(-df.count() // BLOCK)) for df in (left, right))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = left.select(block("motif1", across).alias("i"), each(down).alias("j"), F.lit(0).alias("side"), F.col("motif1").alias("motif"), F.col("p_motif1").alias("p"))
    rows = rows.unionByName(right.select(each(across).alias("i"), block("motif2", down).alias("j"), F.lit(1).alias("side"), F.col("motif2").alias("motif"), F.col("p_motif2").alias("p")))
    if triangle:
        rows = rows.where("i <= j")

    def score(block: pd.DataFrame) -> pd.DataFrame:
        a, b = (block[block.side == side] for side in (0, 1))
        scores = block_scores(list(a.p), list(b.p), method)
        names = [np.repeat(a.motif.to_numpy(object), len(b)), np.tile(b.motif.to_numpy(object), len(a))]
        out = pd.DataFrame({"motif1": names[0], "motif2": names[1], "score": scores.ravel()})
        if not triangle or not len(out):
            return out
        if block.i.iat[0] == block.j.iat[0]:
            return out[out.motif1 < out.motif2]
        swap = out.motif1 > out.motif2
        out.loc[swap, ["motif1", "motif2"]] = out.loc[swap, ["motif2", "motif1"]].to_numpy(object)
        return out

    return rows.groupBy("i", "j").applyInPandas(score, "motif1 string, motif2 string, score double")


def dataset_similarity(dataset1: DataFrame, dataset2: DataFrame | None = None, method: str = "spearman", prior: float = 0.01) -> DataFrame:
    """motif1, motif2, score for all pairs of two data sets, or the symmetric matrix of one.

    Of one data set the upper triangle is computed and mirrored; the diagonal is 1,
    for kl 0. Of two data sets exactly their pairs are computed.
    """
    left = _flat(dataset1, "motif1", prior)
    right = _flat(dataset1 if dataset2 is None else dataset2, "motif2", prior)
    if dataset2 is not None:
        return _in_blocks(left, right, method, False)
    upper = _in_blocks(left, right, method, True)
    mirrored = upper.select(F.col("motif2").alias("motif1"), F.col("motif1").alias("motif2"), "score")
    own = left.select("motif1", F.col("motif1").alias("motif2"), F.lit(0.0 if method == "kl" else 1.0).alias("score"))
    return upper.unionByName(mirrored).unionByName(own)


def pssm_cor(pssm1: DataFrame, pssm2: DataFrame, method: str = "spearman", prior: float = 0.01) -> float:
    return dataset_similarity(pssm1, pssm2, method, prior).agg(F.max("score")).first()[0]


def pssm_diff(pssm1: DataFrame, pssm2: DataFrame, prior: float = 0.01) -> float:
    return dataset_similarity(pssm1, pssm2, "kl", prior).agg(F.min("score")).first()[0]


def pssm_match(pssm: DataFrame, motifs: DataFrame, method: str = "spearman", prior: float = 0.01, best: bool = False) -> DataFrame:
    """The data set's motifs by similarity to one matrix: motif and cor (or kl), best first; ``best``: the first only."""
    name = "kl" if method == "kl" else "cor"
    out = dataset_similarity(pssm, motifs, method, prior).select(F.col("motif2").alias("motif"), F.col("score").alias(name))
    out = out.orderBy(F.asc(name) if method == "kl" else F.desc(name), "motif")
    return out.limit(1).select("motif") if best else out
