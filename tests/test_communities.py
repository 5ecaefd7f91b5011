"""Communities of k-mers against all partitions of small graphs."""

import random

import pytest

from strandlab.functions.kmers import communities


def modularity(n, edges, group):
    m = len(edges)
    if not m:
        return 0.0
    degree = [sum(i in e for e in edges) for i in range(n)]
    inside = sum(group[i] == group[j] for i, j in edges) / m
    return inside - sum(sum(degree[i] for i in range(n) if group[i] == c) ** 2 for c in set(group)) / (2 * m) ** 2


def partitions(n):
    def grow(group):
        if len(group) == n:
            yield group
            return
        for c in range(max(group, default=-1) + 2):
            yield from grow([*group, c])

    return grow([])


def clique(nodes):
    return [(a, b) for k, b in enumerate(nodes) for a in nodes[:k]]


@pytest.mark.parametrize(
    "n, edges, want",
    [
        (3, [], [0, 1, 2]),
        (2, [(0, 1)], [0, 0]),
        (6, clique([0, 1, 2]) + clique([3, 4, 5]) + [(2, 3)], [0, 0, 0, 3, 3, 3]),
        (8, clique([0, 2, 4, 6]) + clique([1, 3, 5, 7]) + [(0, 1)], [0, 1, 0, 1, 0, 1, 0, 1]),
        (7, clique([0, 1, 2]) + clique([3, 4, 5]) + [(2, 3)], [0, 0, 0, 3, 3, 3, 6]),
    ],
)
def test_known_graphs(n, edges, want):
    assert communities(n, edges) == want
    best = max(modularity(n, edges, g) for g in partitions(n))
    assert modularity(n, edges, want) == pytest.approx(best)


def test_near_the_best_of_all_partitions():
    rng = random.Random(1)
    reached = []
    for _ in range(60):
        n = rng.randint(3, 7)
        edges = [e for e in clique(list(range(n))) if rng.random() < 0.45]
        got = communities(n, edges)
        assert got == communities(n, edges) and all(got[c] == c for c in got)
        best = max(modularity(n, edges, g) for g in partitions(n))
        assert modularity(n, edges, got) >= best - 0.09
        reached.append(modularity(n, edges, got) >= best - 1e-9)
    assert sum(reached) > 0.8 * len(reached)
