"""Blocks of motifs against one pair after another."""

import numpy as np
import pytest

from strandlab.operators import similarity as S


def one_pair(a, b, method):
    if len(a) > len(b):
        a, b = b, a
    scores = []
    for k in range(0, len(b) - len(a) + 1, 4):
        x, y = a, b[k : k + len(a)]
        if method == "kl":
            scores.append(((x * np.log(x / y) + y * np.log(y / x)).sum()) / 2)
            continue
        if method == "spearman":
            x, y = S.average_ranks(np.round(x, 12)), S.average_ranks(np.round(y, 12))
        x, y = x - x.mean(), y - y.mean()
        norm = np.sqrt((x * x).sum() * (y * y).sum())
        scores.append((x * y).sum() / norm if norm > 0 else np.nan)
    known = [s for s in scores if s == s]
    return (min if method == "kl" else max)(known) if known else np.nan


def motifs(n, seed):
    rng = np.random.default_rng(seed)
    out = [rng.dirichlet([0.5] * 4, rng.integers(2, 7)).round(2).ravel() + 0.01 for _ in range(n)]
    return [*out, np.full(12, 0.25)]  # one that doesn't vary


@pytest.mark.parametrize("method", S.METHODS)
def test_block_equals_pairs(method):
    a, b = motifs(14, 1), motifs(11, 2)
    want = np.array([[one_pair(x, y, method) for y in b] for x in a])
    assert S.block_scores(a, b, method) == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_all_pairs_once(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(f"m{i}", k, *map(float, rng.dirichlet([1.0] * 4))) for i in range(11) for k in range(3 + i % 3)]
    df = spark.createDataFrame(rows, "motif string, pos int, A double, C double, G double, T double")
    got = {(r.motif1, r.motif2): r.score for r in S.dataset_similarity(df, method="pearson").collect()}
    assert len(got) == 121 and S.dataset_similarity(df, method="pearson").count() == 121
    assert all(got[a, b] == got[b, a] for a, b in got)
    two = {(r.motif1, r.motif2): r.score for r in S.dataset_similarity(df.where("motif < 'm3'"), df.where("motif >= 'm3'"), "pearson").collect()}
    assert two == pytest.approx({k: v for k, v in got.items() if k[0] < "m3" <= k[1]})


def test_five_hundred_motifs():
    many = motifs(499, 5)
    scores = S.block_scores(many, many, "spearman")
    assert scores.shape == (500, 500) and np.nanmax(scores) <= 1 + 1e-9
