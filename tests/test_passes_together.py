"""Requests of one pass that are alike are summed together, with the sums of each alone."""

import numpy as np
import pytest

from strandlab.operators import regression as G


@pytest.mark.parametrize("many", [1, 3, 6, 11])
@pytest.mark.parametrize("width, length, bidirect, folds, responses, part", [(60, 9, True, 1, 1, None), (60, 10, True, 3, 2, 1), (40, 11, False, 1, 1, 0), (12, 3, True, 2, 1, None), (9, 9, True, 1, 2, None), (5, 9, True, 1, 1, None)])
def test_sums_together_equal_those_alone(width, length, bidirect, folds, responses, part, many):
    rng = np.random.default_rng(width + length + many)
    n = 700
    codes, y = rng.integers(0, 5, (n, width)).astype(np.uint8), rng.normal(size=(n, responses))
    fold, parts = rng.integers(0, folds, n).astype(np.int32), rng.integers(0, 4, n)
    bins = G.bin_of(width, max(1, width // 3), 3, True)
    requests = [G.Request(rng.dirichlet([1] * 4, length), rng.dirichlet([1] * 3), bins, bidirect, "gram", folds, part) for _ in range(many)]
    sums = G.Pass(requests)
    assert [at for at, _ in sums.together] == [list(range(many))] and not sums.single
    for k in range(0, n, 300):
        sums.add(codes[k : k + 300], y[k : k + 300], fold[k : k + 300], parts[k : k + 300])
    want = np.concatenate([G.add_up(codes, y, fold, r, parts) for r in requests])
    assert sums.total() == pytest.approx(want, rel=1e-10)


def test_unlike_requests_keep_their_order():
    rng = np.random.default_rng(1)
    n = 50
    codes, y, fold, parts = rng.integers(0, 4, (n, 30)).astype(np.uint8), rng.normal(size=(n, 1)), np.zeros(n, np.int32), rng.integers(0, 4, n)
    bins = G.bin_of(30, 10, 3, False)
    of = lambda length, kind="gram", part=None, least=0.0: G.Request(np.maximum(rng.dirichlet([1] * 4, length), least), np.ones(3) / 3, bins, True, kind, 1, part, **({} if kind == "gram" else {"spat_candidates": rng.dirichlet([1] * 3, 2)}))
    zero = G.replace(of(5), nuc=np.eye(4)[[0, 1, 2, 3, 0]])
    requests = [of(5), of(7), of(5, "moments"), of(5, part=1), of(5), zero, of(2), of(5, part=1)]
    sums = G.Pass(requests)
    assert sorted(at for at, _ in sums.together) == [[0, 4], [1], [3, 7]] and sums.single == [2, 5, 6]
    sums.add(codes, y, fold, parts)
    assert sums.total() == pytest.approx(np.concatenate([G.add_up(codes, y, fold, r, parts) for r in requests]), rel=1e-10)
    assert G.Pass(requests).total() is None


@pytest.mark.parametrize("many", [1, 8])
def test_rows_of_other_parts_only(many):
    rng = np.random.default_rng(4)
    requests = [G.Request(rng.dirichlet([1] * 4, 5), np.ones(3) / 3, G.bin_of(30, 10, 3, False), True, "gram", 1, 1) for _ in range(many)]
    sums = G.Pass(requests)
    sums.add(rng.integers(0, 4, (9, 30)).astype(np.uint8), rng.normal(size=(9, 1)), np.zeros(9, np.int32), np.ones(9, int))
    assert sums.total().shape == (sum(r.size(1) for r in requests),) and not sums.total().any()
