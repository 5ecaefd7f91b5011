"""BagMinHash signatures of weighted sets, vectorised over many sets at once.

Weights are discretised to whole numbers. The weight line of an element is cut
into (0, 1], (1, 2], (2, 4], (4, 8] ...; each interval carries a Poisson process
whose rate is its length. The earliest point of a process is refined by halving
its interval: the point falls into either half by a fair coin, the other half
continues from the same time (the process has no memory). Intervals beyond the
element's weight are dropped, points in unit intervals are real: each hits one
component at random, and the earliest point of a component is its value. All
random numbers depend on the element and the interval only, so two sets agree in
a component with probability sum of minima over sum of maxima of their weights:
the signature is unbiased for the weighted Jaccard similarity.

A process stops when its time passes the largest value in its set's signature,
which makes the work per set about m ln m points whatever its size and weights.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log1p(-((bits >> _U(11)).astype(np.float64) * 2.0**-53))


def _below(bits: np.ndarray, m: int) -> np.ndarray:
    return ((bits >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, m: int) -> np.ndarray:
    """(sets, m) values; a set without elements stays at infinity.

    ``owner``: number of the set of each element; ``element``: 64-bit hashes,
    distinct within a set; ``weight``: whole numbers, 1 at least.
    """
    sig = np.full(sets * m, np.inf)
    if not len(owner):
        return sig.reshape(sets, m)
    element = element.astype(np.uint64, copy=False)
    own, seed, low, size, top = [owner], [mix(element + _GOLD)], [np.zeros(len(owner), np.int64)], [np.ones(len(owner), np.int64)], [weight]
    start = 1
    while (more := weight > start).any():
        at = np.flatnonzero(more)
        own.append(owner[at])
        seed.append(mix(element[at] ^ mix(np.full(1, start + 1, np.uint64) * _GOLD)))
        low.append(np.full(len(at), start, np.int64))
        size.append(np.full(len(at), start, np.int64))
        top.append(weight[at])
        start *= 2
    own, seed, low, size, top = (np.concatenate(x) for x in (own, seed, low, size, top))
    count = np.zeros(len(own), np.uint64)  # random numbers used so far
    time = _exponential(mix(seed)) / size
    highest = np.full(sets, np.inf)
    while len(own):
        unit = size == 1
        o, s, lo, w, c, t = own[unit], seed[unit], low[unit], top[unit], count[unit], time[unit]
        # Few processes: many points of each at once, else one.
        for _ in range(int(np.clip(4096 // max(1, len(o)), 1, 32))):
            np.minimum.at(sig, o * m + _below(mix(s + _GOLD * (c + _U(1))), m), t)
            t = t + _exponential(mix(s + _GOLD * (c + _U(2))))
            c = c + _U(2)
        parts = [(o, s, lo, size[unit], w, c, t)]
        if len(o) < len(own):
            o, s, lo, half, w, t = (x[~unit] for x in (own, seed, low, size // 2, top, time))
            right_first = (mix(s + _GOLD) & _U(1)).astype(bool)
            for right in (False, True):
                begin = lo + half * right
                child = mix(s ^ mix((begin * 2 + right).astype(np.uint64) + _GOLD * half.astype(np.uint64)))
                when = np.where(right_first == right, t, t + _exponential(mix(child)) / half)
                live = begin < w
                parts.append((o[live], child[live], begin[live], half[live], w[live], np.zeros(live.sum(), np.uint64), when[live]))
        own, seed, low, size, top, count, time = (np.concatenate(x) for x in zip(*parts))
        highest = sig.reshape(sets, m).max(axis=1)
        live = time < highest[own]
        own, seed, low, size, top, count, time = (x[live] for x in (own, seed, low, size, top, count, time))
    return sig.reshape(sets, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, m / rows) 64-bit keys; the band's number enters its key."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64))
    bits = bits.reshape(len(sig), -1, rows)
    key = np.arange(1, bits.shape[1] + 1, dtype=np.uint64)[None, :] * _GOLD
    for r in range(rows):
        key = mix(key ^ bits[:, :, r])
    return key


def subset_keys(sig: np.ndarray, subsets: np.ndarray) -> np.ndarray:
    """(sets, subsets) 64-bit keys: each of the values of a subset of components (subsets x size of their numbers)."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64))
    key = np.broadcast_to(np.arange(1, len(subsets) + 1, dtype=np.uint64)[None, :] * _GOLD, (len(sig), len(subsets)))
    for r in range(subsets.shape[1]):
        key = mix(key ^ bits[:, subsets[:, r]])
    return key


def sign_bits(sig: np.ndarray, words: int = 4) -> np.ndarray:
    """One bit of each of the first 64 * words components, packed: agreement is similarity plus half the rest."""
    bits = (mix(np.ascontiguousarray(sig[:, : 64 * words]).view(np.uint64)) >> _U(17)) & _U(1)
    return (bits.reshape(len(sig), words, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
