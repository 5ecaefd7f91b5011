"""Motif regression: greedy search of a matrix and a spatial model against a response.

The model's energy of a sequence, on a linear scale, is the sum over windows and
strands of the product of base probabilities and the window bin's factor. For one
position it is linear in that position's row, for the spatial model linear in the
factors. One pass over the sequences therefore yields, per position, the sums of
D, D D' and D y (D: the four partial derivatives) and the same for the bins; every
one of the 20 moves per position follows from those sums on the driver. A step is
one Spark aggregation of a few hundred numbers, whatever the number of sequences.

Metrics that are not polynomial in the energy (KS, log energies, energy functions)
use a second kind of pass that adds up each candidate's moments or its histogram.

Fits run in lock-step: a search is a generator that asks for sums and gets them,
and one pass over the sequences serves the requests of all searches that still
run (start k-mers, folds of a cross-validation, clusters). Rows carry a bit mask
of the parts of the data they belong to; a search reads the rows of its part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions import kmers as K
from strandlab.functions import pssm as P
from strandlab.functions.sequence import CODES, require_sequences
from strandlab.operators import sampling, similarity
from strandlab.operators.scoring import Motif, Spatial, compute_pwm, cropped, scorer
from strandlab.operators.screening import screen_pwm
from strandlab.operators.stats import EXACT, ks_distance, ks_p_value, least_squares, r_squared, running_mean

#: Step sizes of the four phases, for base probabilities and for spatial factors (fixed values).
PWM_STEPS = (0.05, 0.02, 0.01, 0.005)
SPAT_STEPS = (0.01, 0.01, 0.01, 0.005)
HISTOGRAM = 2048
COMPLEMENT = [3, 2, 1, 0]


@dataclass(frozen=True)
class Options:
    motif_length: int = 15
    score_metric: str = "r2"
    bidirect: bool = True
    spat_bin_size: int | None = None
    spat_num_bins: int | None = None
    spat_model: tuple[float, ...] | None = None
    improve_epsilon: float = 1e-4
    min_nuc_prob: float = 1e-3
    unif_prior: float = 0.05
    seed: int = 60427
    kmer_lengths: tuple[int, ...] = (8,)
    max_cands: int = 10
    min_gap: int = 0
    max_gap: int = 1
    min_kmer_cor: float = 0.08
    val_frac: float = 0.1
    folds: int = 1
    log_energy: bool = False
    energy_epsilon: float = 1e-10
    energy_func: Callable | None = None
    xmin: float = -100.0
    xmax: float = 100.0
    npts: int = 10_000
    optimize_pwm: bool = True
    optimize_spat: bool = True
    symmetrize_spat: bool = True
    alternative: str = "less"
    consensus_thresholds: tuple[float, float] = (0.6, 0.85)
    max_steps: int | None = None  # None: each phase goes on until it gains less than improve_epsilon

    def grid(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The energy function as a table for interpolation."""
        if self.energy_func is None:
            return None
        x = np.linspace(self.xmin, self.xmax, int(self.npts))
        return x, np.asarray([self.energy_func(v) for v in x], float)

    def polynomial(self) -> bool:
        return self.score_metric == "r2" and not self.log_energy and self.energy_func is None


@dataclass
class MotifModel:
    pssm: np.ndarray
    spat: tuple[float, ...]
    spat_bin_size: int
    spat_min: int
    spat_max: int
    bidirect: bool = True
    seed_motif: str | None = None
    consensus: str | None = None
    score: float | None = None
    r2: dict[str, float] = field(default_factory=dict)
    ks: dict[str, float] = field(default_factory=dict)
    db_match: dict = field(default_factory=dict)
    energy_grid: tuple[list[float], list[float]] | None = None
    kmers: list[str] = field(default_factory=list)
    steps: int = 0

    def transform(self, df: DataFrame, out_col: str = "pred") -> DataFrame:
        """``df`` with the log energy of each ``seq`` (through the energy function where there is one)."""
        out = compute_pwm(df, self.motif("model"), self.spatial(), self.spat_min + 1, self.spat_max, self.bidirect, out_col=out_col)
        return out if self.energy_grid is None else out.withColumn(out_col, self.through_grid(F.col(out_col)))

    def through_grid(self, energy: Column) -> Column:
        """The energy function's value of a log energy."""
        if self.energy_grid is None:
            return energy
        x, y = (F.array(*(F.lit(float(v)) for v in g)) for g in self.energy_grid)
        v = F.least(F.greatest(energy, F.element_at(x, 1)), F.element_at(x, -1))
        step = (self.energy_grid[0][-1] - self.energy_grid[0][0]) / (len(self.energy_grid[0]) - 1)
        k = F.least(F.floor((v - F.element_at(x, 1)) / step), F.lit(len(self.energy_grid[0]) - 2)).cast("int")
        value = F.get(y, k) + (F.get(y, k + 1) - F.get(y, k)) * (v - F.get(x, k)) / step
        return F.when(energy.isNotNull(), value)

    def motif(self, name: str) -> Motif:
        return Motif.of(name, self.pssm, prior=0.0)

    def spatial(self) -> Spatial:
        return Spatial(tuple(self.spat), self.spat_bin_size)

    def table(self, spark, name: str = "model") -> DataFrame:
        return spark.createDataFrame([(name, i, *map(float, row)) for i, row in enumerate(self.pssm)], "motif string, pos int, A double, C double, G double, T double")

    def spatial_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i * self.spat_bin_size, float(f)) for i, f in enumerate(self.spat)], "bin int, spat_factor double")


def calculate_bins(length: int, num_bins: int | None = None, bin_size: int | None = None, default: int = 40) -> tuple[int, int]:
    """(number of bins, bin size): odd, at least three by default."""
    if num_bins is not None:
        return num_bins, bin_size if bin_size is not None else length // num_bins
    size = bin_size if bin_size is not None else min(default, length // 3)
    if size < 1:
        raise ValueError("sequences are too short for spatial bins")
    n = length // size
    n -= n % 2 == 0
    if bin_size is None and n < 3:
        raise ValueError("less than 3 spatial bins are not permissible")
    return n, size


def spatial_range(num_bins: int, length: int, bin_size: int) -> tuple[int, int]:
    """(spat_min, spat_max) with one bin in the centre."""
    if num_bins % 2 != 1:
        raise ValueError("the number of bins must be odd")
    if bin_size * num_bins > length:
        raise ValueError("the bins don't fit into the sequence")
    half = num_bins * bin_size / 2
    centre = round(length / 2)
    return round(centre - half), round(centre + half)


def moves(step: float) -> np.ndarray:
    """20 x 4: each base up and down alone, then each pair up together and down together."""
    single = [s * np.eye(4)[i] for i in range(4) for s in (step, -step)]
    double = [s * (np.eye(4)[i] + np.eye(4)[j]) for i in range(3) for s in (step, -step) for j in range(i + 1, 4)]
    return np.array(single + double)


def seed_matrix(motif: str, length: int, prior: float) -> np.ndarray:
    """A k-mer as a matrix: wildcards (* or N) uniform, padded with wildcards on both sides to ``length``."""
    short = max(0, length - len(motif))
    padded = "*" * (short // 2) + motif + "*" * (short - short // 2)
    rows = [np.full(4, 0.25) if c in "*N" else np.where(np.arange(4) == "ACGT".index(c), 1 - 3 * prior, prior) for c in padded]
    return np.array(rows)


# --- sums over sequences -------------------------------------------------------------


#: Letters of a word; words of unknown letters share the last number.
WORD = 3
UNKNOWN = 4**WORD
#: The reverse complement of each word, and the letters of each word: words x (place, letter).
_RC = np.array([sum((3 - v // 4**j % 4) * 4 ** (WORD - 1 - j) for j in range(WORD)) for v in range(UNKNOWN)] + [UNKNOWN], np.intp)
_PLACES = np.array([[v // 4 ** (WORD - 1 - j) % 4 == b for j in range(WORD) for b in range(4)] for v in range(UNKNOWN)] + [[False] * 4 * WORD], float)
#: The letters as vectors; unknown ones are zero.
_LETTERS = np.vstack([np.eye(4), np.zeros(4)])


def _words(codes: np.ndarray) -> np.ndarray:
    """The word that begins at each base of each sequence."""
    many = codes.shape[1] - WORD + 1
    words, bad = np.zeros((len(codes), many), np.uint8), np.zeros((len(codes), many), np.uint8)
    for j in range(WORD):
        letter = codes[:, j : j + many]
        words <<= 2
        words |= letter & 3
        bad |= letter
    words[bad > 3] = UNKNOWN
    return words.astype(np.intp)


def _cuts(length: int) -> list[tuple[int, int]]:
    """A matrix in words: (first place, letters of the word that an earlier word has); the last word may overlap."""
    cuts = [(j, 0) for j in range(0, length - WORD + 1, WORD)]
    if length % WORD:
        cuts.append((length - WORD, WORD - length % WORD))
    return cuts


class Words:
    """The words of sequences of one length, and where those of each window stand, for calls that share them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.held = codes, {}

    def of(self, length: int, bidirect: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each word of a matrix: that of every window (sequences x windows, of the second strand after the first), and its number in a table of sequences x words."""
        if (length, bidirect) not in self.held:
            n, width = self.codes.shape
            windows, words = width - length + 1, _words(self.codes)
            first = np.arange(n)[:, None] * (UNKNOWN + 1)
            out = []
            for j, _ in _cuts(length):
                strands = [words[:, j : j + windows]]
                if bidirect:
                    strands.append(_RC.take(words[:, length - WORD - j : length - WORD - j + windows]))
                own = np.concatenate(strands, axis=1)
                out.append((own, (own + first).ravel()))
            self.held[length, bidirect] = out
        return self.held[length, bidirect]


def derivatives(codes: np.ndarray, nuc: np.ndarray, spat: np.ndarray, bins: np.ndarray, bidirect: bool, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """D: sequences x positions x 4, S: sequences x bins. Windows with unknown letters count nothing.

    A window's product comes from tables of words; products are added up by the word
    at each place of the window, and words by their letters. ``words``: of ``codes``,
    where several calls share them.
    """
    n, width = codes.shape
    length = len(nuc)
    windows = width - length + 1
    if windows < 1 or not n:
        return np.zeros((n, length, 4)), np.zeros((n, len(spat)))
    if length < WORD or not (nuc > 0).all():
        return _plain_derivatives(codes, nuc, spat, bins, bidirect)
    words = Words(codes) if words is None else words
    own = words.of(length, bidirect)
    bin_at = np.tile(bins[:windows], 2 if bidirect else 1)
    onto = np.zeros((len(bin_at), len(spat)))
    onto[np.arange(len(bin_at)), bin_at] = 1
    cuts = _cuts(length)
    prod = 1.0
    for (j, old), (word, _) in zip(cuts, own):
        prod = prod * _table(nuc[j : j + WORD], old).take(word)
    s = prod @ onto
    prod *= spat[bin_at]
    d, held = np.empty((n, length * 4)), n * (UNKNOWN + 1)
    for (j, old), (_, cell) in zip(cuts, own):
        d[:, (j + old) * 4 : (j + WORD) * 4] = np.bincount(cell, prod.ravel(), held).reshape(n, -1) @ _PLACES[:, old * 4 :]
    d /= nuc.ravel()
    return d.reshape(n, length, 4), s


def _table(nuc: np.ndarray, old: int) -> np.ndarray:
    """The probability of each word's letters from place ``old`` on; 0 for unknown ones."""
    table = np.ones(1)
    for j, row in enumerate(nuc):
        table = np.outer(table, row if j >= old else np.ones(4)).ravel()
    return np.append(table, 0.0)


def _plain_derivatives(codes: np.ndarray, nuc: np.ndarray, spat: np.ndarray, bins: np.ndarray, bidirect: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same, letter by letter: without each position's own factor, which may be zero."""
    n, width = codes.shape
    length = len(nuc)
    windows = width - length + 1
    d, s = np.zeros((n, length, 4)), np.zeros((n, len(spat)))
    letters = np.array([codes == b for b in range(4)], float)
    bins = bins[:windows]
    table = np.column_stack([nuc, np.zeros(length)])
    tables = [(table, list(range(length)), [0, 1, 2, 3])]
    if bidirect:
        tables.append((table[::-1][:, [3, 2, 1, 0, 4]], list(range(length))[::-1], [3, 2, 1, 0]))
    onto = np.zeros((windows, len(spat)))
    onto[np.arange(windows), bins] = 1
    weight = spat[bins]
    for t, owner, base in tables:
        prod = t[0][codes[:, :windows]]
        for j in range(1, length):
            prod *= t[j][codes[:, j : j + windows]]
        s += prod @ onto
        for j in range(length):
            share = np.tile(weight, (n, 1))
            for i in range(length):
                if i != j:
                    share *= t[i][codes[:, i : i + windows]]
            for b in range(4):
                d[:, owner[j], base[b]] += np.einsum("nw,nw->n", share, letters[b][:, j : j + windows])
    return d, s


def bin_of(windows: int, bin_size: int, num_bins: int, fold: bool) -> np.ndarray:
    """The bin of each window start; ``fold``: bins right of the centre count to their mirror image."""
    b = np.minimum(np.arange(windows) // bin_size, num_bins - 1)
    centre = num_bins // 2
    return np.where(b > centre, 2 * centre - b, b) if fold else b


@dataclass(frozen=True)
class Request:
    """What one pass adds up."""

    nuc: np.ndarray
    spat: np.ndarray
    bins: np.ndarray
    bidirect: bool
    kind: str  # 'gram', 'moments' or 'histogram'
    folds: int = 1
    part: int | None = None  # rows whose mask has this bit; None: all
    pwm_candidates: np.ndarray | None = None  # candidates x (position, A, C, G, T)
    spat_candidates: np.ndarray | None = None  # candidates x bins
    log_energy: bool = False
    energy_epsilon: float = 0.0
    grid: tuple | None = None

    def candidates(self) -> int:
        return sum(len(c) for c in (self.pwm_candidates, self.spat_candidates) if c is not None)

    def size(self, responses: int) -> int:
        """Numbers that a pass gives for it."""
        rows, bins, c = len(self.nuc), len(self.spat), self.candidates()
        own = {"gram": rows * (20 + 4 * responses) + bins * (1 + bins + responses), "moments": c * (2 + responses), "histogram": 2 * c * HISTOGRAM}[self.kind]
        return max(1, self.folds) * (1 + 2 * responses + own)


def add_up(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, r: Request, parts: np.ndarray | None = None, words: Words | None = None) -> np.ndarray:
    """A vector of sums for each fold, flattened; additive over sequences."""
    if r.part is not None:
        own = (parts >> r.part) & 1 == 1
        if not own.all():
            codes, y, fold, words = codes[own], y[own], fold[own], None
    d, s = derivatives(codes, r.nuc, r.spat, r.bins, r.bidirect, words)
    out = []
    for f in range(r.folds):
        at = fold == f if r.folds > 1 else slice(None)
        df, sf, yf = d[at], s[at], y[at]
        base = [np.array([len(yf)]), yf.sum(0), (yf * yf).sum(0)]
        if r.kind == "gram":
            k = np.arange(len(r.nuc))
            flat = df.reshape(len(df), 4 * len(k))
            parts = [df.sum(0), (flat.T @ flat).reshape(len(k), 4, len(k), 4)[k, :, k], flat.T @ yf, sf.sum(0), sf.T @ sf, sf.T @ yf]
        else:
            e = []
            if r.pwm_candidates is not None:
                e.append(np.einsum("nca,ca->nc", df[:, r.pwm_candidates[:, 0].astype(int)], r.pwm_candidates[:, 1:]))
            if r.spat_candidates is not None:
                e.append(sf @ r.spat_candidates.T)
            e = np.concatenate(e, axis=1)
            if r.kind == "moments":
                if r.log_energy:
                    e = np.log(e + r.energy_epsilon)
                if r.grid is not None:
                    e = np.interp(e, *r.grid)
                parts = [e.sum(0), (e * e).sum(0), e.T @ yf]
            else:  # counts of both classes by log energy
                with np.errstate(divide="ignore"):
                    k = np.clip((np.log(e) + 80) / 85 * HISTOGRAM, 0, HISTOGRAM - 1).astype(np.int64)
                cells = k + np.arange(e.shape[1]) * HISTOGRAM
                one = yf[:, 0] == 1
                size = e.shape[1] * HISTOGRAM
                parts = [np.bincount(cells[one].ravel(), minlength=size), np.bincount(cells[~one].ravel(), minlength=size)]
        out += [np.ravel(p).astype(float) for p in base + parts]
    return np.concatenate(out)


#: Requests from which on a product of matrices is faster than sums by words; bases that are taken at once for it and for sums by words.
MANY, FEW_BASES, MANY_BASES = 6, 16_384, 4_096


class Grams:
    """Sums of requests for grams of one length, bins and part, all at once.

    Where there are many, a sequence's windows are written out as letters (windows x
    (place, letter)); one product with the windows' energies on both strands gives the
    derivatives of all requests. Few are summed by words. One more product gives the
    derivatives' products with each other and the responses.
    """

    def __init__(self, requests: list[Request]):
        first = self.first = requests[0]
        self.length, self.many = len(first.nuc), len(requests)
        nucs, self.spats = np.array([r.nuc for r in requests]), np.array([r.spat for r in requests])
        self.both = 2 * self.many if first.bidirect else self.many
        # Words x requests, of the second strand after the first; sums by words look its words up in the table of the first.
        strands = np.concatenate([nucs, nucs[:, ::-1, ::-1]])[: self.both if self.many >= MANY else self.many]
        self.tables = [np.stack([_table(m[j : j + WORD], old) for m in strands], axis=1) for j, old in _cuts(self.length)]
        self.inverse = 1 / nucs.reshape(self.many, -1)
        self.totals = self.bases = None
        self.room: dict[str, np.ndarray] = {}

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """Memory that slices share: new memory for each costs more than the sums."""
        size = math.prod(shape)
        if name not in self.room or self.room[name].size < size:
            self.room[name] = np.empty(size)
        return self.room[name][:size].reshape(shape)

    def add(self, codes: np.ndarray, y: np.ndarray, fold: np.ndarray, parts: np.ndarray | None) -> None:
        r = self.first
        if r.part is not None:
            own = (parts >> r.part) & 1 == 1
            if not own.all():
                codes, y, fold = codes[own], y[own], fold[own]
        windows = codes.shape[1] - self.length + 1
        letters, bins = 4 * self.length, self.spats.shape[1]
        own = letters + bins
        if self.totals is None:
            self.totals, self.bases = np.zeros((max(1, r.folds), self.many, own, own + y.shape[1] + 1)), np.zeros((max(1, r.folds), 1 + 2 * y.shape[1]))
        rows = max(1, (MANY_BASES if self.many >= MANY else FEW_BASES) // max(1, codes.shape[1]))
        for k in range(0, len(codes), rows):
            here, yk, fk = codes[k : k + rows], y[k : k + rows], fold[k : k + rows]
            # Sequences x requests x (derivatives, energies by bin, responses, 1).
            z = self._space("z", len(here), self.many, own + y.shape[1] + 1)
            z[:, :, own:-1] = yk[:, None, :]
            z[:, :, -1] = 1
            if windows < 1:
                z[:, :, :own] = 0
            else:
                (self._by_product if self.many >= MANY else self._by_words)(here, windows, z[:, :, :letters], z[:, :, letters:own])
                z[:, :, :letters] *= self.inverse
            for f in range(len(self.totals)):
                at = fk == f if r.folds > 1 else slice(None)
                zf, yf = z[at], yk[at]
                self.totals[f] += np.matmul(zf[:, :, :own].transpose(1, 2, 0), zf.transpose(1, 0, 2))
                self.bases[f] += np.concatenate([[len(yf)], yf.sum(0), (yf * yf).sum(0)])

    def _by_product(self, codes: np.ndarray, windows: int, d: np.ndarray, by_bin: np.ndarray) -> None:
        n, letters, bins, m = len(codes), 4 * self.length, self.spats.shape[1], self.many
        words = _words(codes)
        energy, factor = self._space("energy", n, windows, self.both), self._space("factor", n, windows, self.both)
        for i, ((j, _), table) in enumerate(zip(_cuts(self.length), self.tables)):
            table.take(words[:, j : j + windows], axis=0, out=factor if i else energy, mode="clip")
            if i:
                energy *= factor
        bin_at = self.first.bins[:windows]
        onto = np.zeros((bins, windows))
        onto[bin_at, np.arange(windows)] = 1
        summed = np.matmul(onto, energy, out=self._space("summed", n, bins, self.both)).transpose(0, 2, 1)
        energy *= np.tile(self.spats[:, bin_at].T, self.both // m)
        one = _LETTERS.take(codes, axis=0, out=self._space("one", *codes.shape, 4), mode="clip")
        written = self._space("written", n, windows, letters)
        np.copyto(written, np.lib.stride_tricks.as_strided(one, written.shape, one.strides))
        strands = np.matmul(energy.transpose(0, 2, 1), written, out=self._space("strands", n, self.both, letters))
        if self.both > m:  # the second strand has the letters of the first from its end, as their complements
            np.add(strands[:, :m], strands[:, m:, ::-1], out=d)
            np.add(summed[:, :m], summed[:, m:], out=by_bin)
        else:
            d[:], by_bin[:] = strands, summed

    def _by_words(self, codes: np.ndarray, windows: int, d: np.ndarray, by_bin: np.ndarray) -> None:
        n, bins = len(codes), self.spats.shape[1]
        own = Words(codes).of(self.length, self.first.bidirect)
        bin_at = np.tile(self.first.bins[:windows], self.both // self.many)
        onto = np.zeros((len(bin_at), bins))
        onto[np.arange(len(bin_at)), bin_at] = 1
        energy, factor = self._space("energy", n, len(bin_at)), self._space("factor", n, len(bin_at))
        for c, spat in enumerate(self.spats):
            for i, (table, (word, _)) in enumerate(zip(self.tables, own)):
                table[:, c].take(word, out=factor if i else energy, mode="clip")
                if i:
                    energy *= factor
            by_bin[:, c] = energy @ onto
            energy *= spat[bin_at]
            for (j, old), (_, cell) in zip(_cuts(self.length), own):
                d[:, c, (j + old) * 4 : (j + WORD) * 4] = np.bincount(cell, energy.ravel(), n * (UNKNOWN + 1)).reshape(n, -1) @ _PLACES[:, old * 4 :]

    def vectors(self) -> list[np.ndarray]:
        """What ``add_up`` gives for each request."""
        k, letters, bins = np.arange(self.length), 4 * self.length, self.spats.shape[1]
        out: list = [[] for _ in range(self.many)]
        for base, total in zip(self.bases, self.totals):
            for c, t in enumerate(total):
                d, s = t[:letters], t[letters:]
                gram = d[:, :letters].reshape(self.length, 4, self.length, 4)[k, :, k]
                own = slice(letters, letters + bins)
                out[c] += [base, d[:, -1], gram.ravel(), d[:, letters + bins : -1].ravel(), s[:, -1], s[:, own].ravel(), s[:, letters + bins : -1].ravel()]
        return [np.concatenate(v) for v in out]


class Pass:
    """The sums of some requests over slices of sequences, as one vector."""

    def __init__(self, requests: list[Request]):
        self.requests, self.found = requests, None
        alike: dict[tuple, list[int]] = {}
        for i, r in enumerate(requests):
            if r.kind == "gram" and len(r.nuc) >= WORD and (r.nuc > 0).all():
                alike.setdefault((len(r.nuc), len(r.spat), r.bins.tobytes(), r.bidirect, r.folds, r.part), []).append(i)
        self.together = [(at, Grams([requests[i] for i in at])) for at in alike.values()]
        self.single = sorted(set(range(len(requests))) - {i for at, _ in self.together for i in at})

    def add(self, codes: np.ndarray, y: np.ndarray, fold: np.ndarray, parts: np.ndarray) -> None:
        for _, grams in self.together:
            grams.add(codes, y, fold, parts)
        words = Words(codes)
        own = [add_up(codes, y, fold, self.requests[i], parts, words) for i in self.single]  # not polynomial
        self.found = own if self.found is None else [a + b for a, b in zip(self.found, own)]

    def total(self) -> np.ndarray | None:
        """None where there was no slice."""
        if self.found is None:
            return None
        out: dict[int, np.ndarray] = dict(zip(self.single, self.found))
        for at, grams in self.together:
            out |= zip(at, grams.vectors())
        return np.concatenate([out[i] for i in range(len(self.requests))])


#: Bases of a task's sequences, where there are more than the cores can share.
TASK_BASES = 1 << 26


def even_tasks(df: DataFrame, least: int) -> int:
    """A task for each core, or ``least``."""
    return max(least, df.sparkSession.sparkContext.defaultParallelism)


class SparkSums:
    """Sums over a DataFrame of encoded sequences, added up on the executors.

    The driver receives at most ``FAN`` vectors and ``LARGEST`` bytes at once.
    ``parts``: a bigint with a bit for each part of the data that a row belongs to;
    ``bases``: how many the sequences have in all, where it is known.
    """

    FAN, LARGEST = 32, 64 << 20

    def __init__(self, df: DataFrame, responses: list[str], folds: int, key: str = "seq_id", seed: int = 60427, parts: Column | None = None, bases: int | None = None):
        fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(max(1, folds))).cast("int")
        y = F.array(*(F.col(c).cast("double") for c in responses))
        mask = F.lit(-1).cast("bigint") if parts is None else parts
        # Encoded once: a row holds a slice of sequences as bytes, which passes read without taking them apart.
        rows = df.select("seq", y.alias("y"), fold.alias("fold"), mask.alias("parts")).mapInArrow(_encoded, "width int, codes binary, y binary, fold binary, parts binary")
        # Dealt out evenly: every pass takes as long as its longest task, and rows often come in a few large partitions.
        self.tasks = even_tasks(df, rows.rdd.getNumPartitions() if bases is None else -(-bases // TASK_BASES))
        self.rows = rows.repartition(self.tasks).persist()
        self.responses = len(responses)

    def __call__(self, r: Request) -> np.ndarray:
        return self.many([r])[0]

    def many(self, requests: list[Request]) -> list[np.ndarray]:
        """The sums of each request, from one pass (several where their vectors are large)."""
        out, group, size = [], [], 0
        for r in requests:
            own = 8 * r.size(self.responses)
            if group and size + own > self.LARGEST:
                out += self._pass(group)
                group, size = [], 0
            group.append(r)
            size += own
        return out + self._pass(group)

    def _pass(self, requests: list[Request]) -> list[np.ndarray]:
        shared = self.rows.sparkSession.sparkContext.broadcast(requests)
        sizes = [r.size(self.responses) for r in requests]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Pass(shared.value)
            for batch in batches:
                for part in _slices(batch):
                    sums.add(*part)
            total = sums.total()
            if total is not None:
                yield _vector(total)

        vectors = self.rows.mapInArrow(work, "v array<double>")
        tasks = self.tasks
        fan = max(1, min(self.FAN, self.LARGEST // (8 * sum(sizes))))
        while tasks > fan:
            tasks = -(-tasks // max(2, fan))
            vectors = vectors.repartition(tasks).mapInArrow(_added, "v array<double>")
        total = np.zeros(sum(sizes))
        for chunk in vectors.toArrow().column("v").chunks:
            total += chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(total)).sum(axis=0)
        shared.destroy()
        return np.split(total, np.cumsum(sizes)[:-1])

    def close(self) -> None:
        self.rows.unpersist()


def _vector(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], names=["v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        part = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
        total = part if total is None else total + part
    if total is not None:
        yield _vector(total)


#: Bases of a slice of sequences.
SLICE = 65_536


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(codes.shape[1], codes.tobytes(), y.tobytes(), fold.tobytes(), parts.tobytes()) for codes, y, fold, parts in matrices(batch)]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["width", "codes", "y", "fold", "parts"])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``_encoded`` wrote."""
    for width, codes, y, fold, parts in zip(*(batch.column(c) for c in ("width", "codes", "y", "fold", "parts"))):
        fold = np.frombuffer(fold.as_buffer(), np.int32)
        yield np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(fold), width.as_py()), np.frombuffer(y.as_buffer()).reshape(len(fold), -1), fold, np.frombuffer(parts.as_buffer(), np.int64)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Sequences of one length together, in slices that keep the derivative arrays small."""
    seqs = batch.column("seq").cast(pa.large_string())
    y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int32)
    parts = batch.column("parts").to_numpy(zero_copy_only=False)
    lengths = pc.utf8_length(seqs).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(1, int(SLICE // max(1, n)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            text = "".join(seqs.take(pa.array(part)).to_pylist())
            codes = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8).reshape(len(part), n)]
            yield codes, np.ascontiguousarray(y[part], float), fold[part], parts[part]


class LocalSums:
    """The same over arrays in the driver, for small data and tests."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, folds: int = 1):
        self.codes, self.y, self.responses = codes, np.asarray(y, float).reshape(len(codes), -1), np.asarray(y).reshape(len(codes), -1).shape[1]
        self.fold = np.arange(len(codes)) % max(1, folds)

    def __call__(self, r: Request) -> np.ndarray:
        return add_up(self.codes, self.y, self.fold, r)

    def many(self, requests: list[Request]) -> list[np.ndarray]:
        return [self(r) for r in requests]

    def close(self) -> None:
        pass


# --- scores from sums ----------------------------------------------------------------


def r2_of(n: float, ex, ex2, exy, ey, ey2) -> np.ndarray:
    """Squared correlations added over responses; ``exy``: candidates x responses."""
    ex, ex2, exy = ex / n, ex2 / n, exy / n
    ey, ey2 = ey / n, ey2 / n
    var = ex2 - ex * ex
    vy = ey2 - ey * ey
    cov = exy - ex[:, None] * ey[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = cov * cov / (var[:, None] * vy[None, :])
    r2 = np.where(np.isfinite(r2) & (var[:, None] > 1e-300), r2, 0.0)
    return r2.sum(1)


#: What rounding moves a sum by, as a share of the sum of its absolute terms (with room for sums over many rows).
ROUNDING = 1e-13


def rounding_of(n: float, ex, ex2, exy, ey, ey2) -> np.ndarray:
    """How far rounding may move ``r2_of``; 0 where there is no variance beyond it."""
    with np.errstate(all="ignore"):
        ex, ex2, exy = ex / n, ex2 / n, exy / n
        ey, ey2 = ey / n, ey2 / n
        var, var_off = (ex2 - ex * ex)[:, None], ROUNDING * (ex2 + ex * ex)[:, None]
        cov = exy - ex[:, None] * ey[None, :]
        cov_off = ROUNDING * (np.sqrt(ex2[:, None] * ey2[None, :]) + np.abs(ex[:, None] * ey[None, :]))
        off = (2 * np.abs(cov) * cov_off + cov * cov * var_off / var) / (var * (ey2 - ey * ey)[None, :])
        return np.where(np.isfinite(off) & (var > 2 * var_off), off, 0.0).sum(1)


def ks_of(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """One-sided distance, class 1 high, by candidate."""
    up = np.cumsum(ones[:, ::-1], axis=1) / max(1.0, ones[0].sum())
    down = np.cumsum(zeros[:, ::-1], axis=1) / max(1.0, zeros[0].sum())
    return np.maximum((up - down).max(1), 0.0)


class _Reader:
    def __init__(self, v: np.ndarray):
        self.v, self.at = v, 0

    def take(self, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        out = self.v[self.at : self.at + n].reshape(shape)
        self.at += n
        return out


Fit = tuple[np.ndarray, np.ndarray, float, int]  # matrix, spatial factors, score, steps


def fit(sums, start: np.ndarray, o: Options, length: int, spat_start: np.ndarray | None = None) -> Fit:
    """One search from a start matrix; ``length``: of the sequences."""
    found = search(start, o, length, sums.responses, spat_start)
    try:
        request = next(found)
        while True:
            request = found.send(sums(request))
    except StopIteration as end:
        return end.value


def fit_together(sums, searches: list[Generator[Request, np.ndarray, Fit]]) -> list[Fit]:
    """All searches in lock-step: each pass answers every search that still runs."""
    done: dict[int, Fit] = {}
    pending: dict[int, Request] = {}

    def onward(k: int, answer: np.ndarray | None) -> None:
        try:
            pending[k] = searches[k].send(answer)
        except StopIteration as end:
            pending.pop(k, None)
            done[k] = end.value

    for k in range(len(searches)):
        onward(k, None)
    while pending:
        now = list(pending)
        for k, answer in zip(now, sums.many([pending[k] for k in now])):
            onward(k, answer)
    return [done[k] for k in range(len(searches))]


def search(start: np.ndarray, o: Options, length: int, responses: int, spat_start: np.ndarray | None = None, part: int | None = None, trace: list | None = None) -> Generator[Request, np.ndarray, Fit]:
    """The greedy search: asks for the sums of each step.

    ``part``: the part of the data that it reads; ``trace``: gets (step, position, move, score) of each move of the matrix.
    """
    num_bins, size = calculate_bins(length, o.spat_num_bins, o.spat_bin_size)
    mirrored = o.symmetrize_spat and o.bidirect
    nuc = np.array(start, float)
    spat = np.full(num_bins, 1.0 / num_bins) if spat_start is None else np.array(spat_start, float)
    bins = bin_of(length, size, num_bins, mirrored)
    rows = len(nuc)
    score, steps = 0.0, 0

    for pwm_step, spat_step in zip(PWM_STEPS, SPAT_STEPS):
        neighbours = moves(pwm_step)
        while o.max_steps is None or steps < o.max_steps:
            before = score
            q = np.array([[trial(nuc[k], by, o.min_nuc_prob) for by in neighbours] for k in range(rows)])
            spats = np.array([np.where(np.arange(num_bins) == b, spat + by, spat) for b in range(num_bins) for by in (spat_step, -spat_step)])
            request = Request(nuc, spat, bins, o.bidirect, "gram" if o.polynomial() else "histogram" if o.score_metric == "ks" else "moments", o.folds, part)
            if not o.polynomial():
                where = np.repeat(np.arange(rows), len(neighbours))
                request = replace(request, pwm_candidates=np.column_stack([where, q.reshape(-1, 4)]), spat_candidates=spats, log_energy=o.log_energy, energy_epsilon=o.energy_epsilon, grid=o.grid())
            read = _Reader((yield request))
            pwm_folds, spat_folds, weights, whole = [], [], [], None
            for _ in range(max(1, o.folds)):
                n, ey, ey2 = read.take(1)[0], read.take(responses), read.take(responses)
                if request.kind == "gram":
                    parts = [n, ey, ey2, read.take(rows, 4), read.take(rows, 4, 4), read.take(rows, 4, responses), read.take(num_bins), read.take(num_bins, num_bins), read.take(num_bins, responses)]
                elif request.kind == "moments":
                    c = q.shape[0] * q.shape[1] + len(spats)
                    parts = [n, ey, ey2, read.take(c), read.take(c), read.take(c, responses)]
                else:
                    c = q.shape[0] * q.shape[1] + len(spats)
                    parts = [n, ey, ey2, read.take(c, HISTOGRAM), read.take(c, HISTOGRAM)]
                p, s = _candidate_scores(request.kind, parts, q, spats)
                pwm_folds.append(p)
                spat_folds.append(s)
                whole = parts if whole is None else [a + b for a, b in zip(whole, parts)]
            pwm_scores, spat_scores = _candidate_scores(request.kind, whole, q, spats)
            if o.optimize_pwm:
                # With folds, the move of the best mean rank among those that improve the whole.
                rank = np.mean([np.argsort(np.argsort(p.ravel())) for p in pwm_folds], axis=0) if o.folds > 1 else pwm_scores.ravel()
                rank = np.where(pwm_scores.ravel() > score, rank, -np.inf)
                best = int(rank.argmax())
                if not np.isfinite(rank[best]):
                    break
                if o.folds <= 1:
                    # Moves that only rounding tells apart are equal: the first is made, in whatever order rows are added up.
                    off = _candidate_rounding(request.kind, whole, q)
                    best = int(np.flatnonzero(rank + off >= rank[best] - off[best])[0])
                k, m = divmod(best, len(neighbours))
                row = np.maximum(nuc[k] + neighbours[m], np.where(neighbours[m] != 0, o.min_nuc_prob, 0))
                nuc[k] = row / row.sum()
                score = float(pwm_scores.ravel()[best])
                if trace is not None:
                    trace.append((steps + 1, k, m, score))
            if o.optimize_spat:
                allowed = np.where((spats >= 0).all(axis=1), spat_scores, -np.inf)
                if mirrored:
                    allowed[2 * (num_bins // 2 + 1) :] = -np.inf  # mirrored bins carry nothing
                best = int(allowed.argmax())
                if allowed[best] > score:
                    spat = spats[best] / (1 + (spat_step if best % 2 == 0 else -spat_step))
                    score = float(allowed[best])
            steps += 1
            if not score > before + o.improve_epsilon:
                break
        if mirrored:
            spat = spat[np.minimum(np.arange(num_bins), 2 * (num_bins // 2) - np.arange(num_bins))]
    return nuc, spat, score, steps


def _candidate_scores(kind: str, parts: list, q: np.ndarray, spats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, ey, ey2 = parts[:3]
    rows, many = q.shape[:2]
    if kind == "gram":
        m, g, c, sm, sg, sc = parts[3:]
        pwm = np.array([r2_of(n, q[k] @ m[k], np.einsum("ma,ab,mb->m", q[k], g[k], q[k]), q[k] @ c[k], ey, ey2) for k in range(rows)])
        return pwm, r2_of(n, spats @ sm, np.einsum("ma,ab,mb->m", spats, sg, spats), spats @ sc, ey, ey2)
    flat = r2_of(n, parts[3], parts[4], parts[5], ey, ey2) if kind == "moments" else ks_of(parts[3], parts[4])
    return flat[: rows * many].reshape(rows, many), flat[rows * many :]


def _candidate_rounding(kind: str, parts: list, q: np.ndarray) -> np.ndarray:
    """How far rounding may move the score of each move of the matrix; counts are exact."""
    n, ey, ey2 = parts[:3]
    rows, many = q.shape[:2]
    if kind == "gram":
        m, g, c = parts[3:6]
        return np.concatenate([rounding_of(n, q[k] @ m[k], np.einsum("ma,ab,mb->m", q[k], g[k], q[k]), q[k] @ c[k], ey, ey2) for k in range(rows)])
    return rounding_of(n, *(v[: rows * many] for v in parts[3:6]), ey, ey2) if kind == "moments" else np.zeros(rows * many)


# --- entry points --------------------------------------------------------------------


def is_binary(df: DataFrame, responses: list[str]) -> bool:
    return len(responses) == 1 and df.agg(F.count_if(~F.col(responses[0]).isin(0, 1))).first()[0] == 0


def _length(df: DataFrame) -> int:
    return _length_and_kind(df, [])[0]


def _length_and_kind(df: DataFrame, responses: list[str]) -> tuple[int, bool, int]:
    """The sequences' one length, whether the response is binary, and how many bases there are, by one pass."""
    other = F.count_if(~F.col(responses[0]).isin(0, 1)) if len(responses) == 1 else F.lit(1)
    r = df.agg(F.min(F.length("seq")), F.max(F.length("seq")), other, F.sum(F.length("seq"))).first()
    if r[0] is None:
        raise ValueError("no sequences")
    if r[0] != r[1]:
        raise ValueError("all sequences must have the same length")
    return r[0], r[2] == 0, r[3]


def _consensus(df: DataFrame, model: MotifModel, o: Options) -> str | None:
    return P.consensus(model.table(df.sparkSession), *o.consensus_thresholds).first().consensus


def scored(df: DataFrame, model: MotifModel, responses: list[str], o: Options, binary: bool) -> MotifModel:
    """The model with its r squared, KS distance and score on ``df``."""
    pred = model.transform(df)
    row = pred.agg(*(r_squared(F.col("pred"), F.col(c)).alias(c) for c in responses)).first()
    model.r2 = {c: row[c] if row[c] is not None else 0.0 for c in responses}
    model.score = float(np.mean(list(model.r2.values())))
    if binary:
        k = ks_distance(pred.withColumn("__all", F.lit(0)), "pred", responses[0], ["__all"], o.alternative).first()
        ties = None
        if 0 < k.n1 * k.n0 < EXACT:  # so many values at most
            ties = [r["count"] for r in pred.where(F.col("pred").isNotNull()).groupBy("pred").count().orderBy("pred").collect()]
        model.ks = {"D": k.D or 0.0, "p": ks_p_value(k.D or 0.0, max(1, k.n1), max(1, k.n0), o.alternative, ties)}
        model.score = model.ks["D"]
    return model


def fit_from(df: DataFrame, responses: list[str], start: str | np.ndarray, o: Options, length: int, spat_start=None) -> MotifModel:
    """One fit from a k-mer or a matrix."""
    model = fits_from(df, responses, [(start, None)], o, length, spat_start=spat_start)[0]
    model.consensus = _consensus(df, model, o)
    return model


def fits_from(df: DataFrame, responses: list[str], starts: list[tuple[str | np.ndarray, int | None]], o: Options, length: int, parts: Column | None = None, spat_start=None, bases: int | None = None) -> list[MotifModel]:
    """A fit from each (k-mer or matrix, part), all in lock-step; without consensus."""
    num_bins, size = calculate_bins(length, o.spat_num_bins, o.spat_bin_size)
    low, high = spatial_range(num_bins, length, size)
    inner = replace(o, spat_num_bins=num_bins, spat_bin_size=size)
    searches = []
    for start, part in starts:
        matrix = seed_matrix(start, o.motif_length, o.unif_prior) if isinstance(start, str) else np.asarray(start, float) / np.sum(start, axis=1, keepdims=True)
        matrix = np.maximum(matrix, o.min_nuc_prob)
        searches.append(search(matrix / matrix.sum(1, keepdims=True), inner, high - low, len(responses), spat_start if spat_start is not None else o.spat_model, part))
    sums = SparkSums(df.withColumn("seq", cropped(F.col("seq"), low + 1, high)), responses, o.folds, seed=o.seed, parts=parts, bases=bases)
    try:
        found = fit_together(sums, searches)
    finally:
        sums.close()
    grid = o.grid()
    grid = None if grid is None else tuple(map(list, grid))
    return [MotifModel(nuc, tuple(map(float, spat)), size, low, high, o.bidirect, start if isinstance(start, str) else None, energy_grid=grid, steps=steps) for (start, _), (nuc, spat, _, steps) in zip(starts, found)]


def step_scores(df: DataFrame, response: str, model: MotifModel, step: float, o: Options = Options()) -> list[tuple[int, int, float]]:
    """(position, move, r squared) of every move that a step of a fit could make from ``model``, by one pass."""
    sums = SparkSums(df.withColumn("seq", cropped(F.col("seq"), model.spat_min + 1, model.spat_max)), [response], 1)
    try:
        bins = bin_of(model.spat_max - model.spat_min, model.spat_bin_size, len(model.spat), o.symmetrize_spat and o.bidirect)
        read = _Reader(sums(Request(model.pssm, np.array(model.spat), bins, model.bidirect, "gram")))
    finally:
        sums.close()
    rows, bins_n = len(model.pssm), len(model.spat)
    parts = [read.take(1)[0], read.take(1), read.take(1), read.take(rows, 4), read.take(rows, 4, 4), read.take(rows, 4, 1), read.take(bins_n), read.take(bins_n, bins_n), read.take(bins_n, 1)]
    q = np.array([[trial(row, by, o.min_nuc_prob) for by in moves(step)] for row in model.pssm])
    scores = _candidate_scores("gram", parts, q, np.array([model.spat]))[0]
    return [(k, m, float(v)) for k, row in enumerate(scores) for m, v in enumerate(row)]


def trial(row: np.ndarray, by: np.ndarray, least: float) -> np.ndarray:
    """A position's probabilities after a move, not yet normalised."""
    q = row + by
    return np.where((by != 0) & (q <= 0), least, q)


#: Parts of the data that are fitted together: bits of a mask.
MOST_PARTS = 63


def _in_part(k: int) -> Column:
    return F.col("__parts").bitwiseAND(F.lit(1 << k)) != 0


def scores_together(df: DataFrame, models: list[tuple[MotifModel, int]], responses: list[str], o: Options, binary: bool) -> list[float]:
    """The score of each model on the rows of its part, by one pass; the models have one range and one strandedness."""
    first = models[0][0]
    motifs = [m.motif(f"m{j}") for j, (m, _) in enumerate(models)]
    spats = {f"m{j}": m.spatial() for j, (m, _) in enumerate(models)}
    energies = scorer(df, motifs, spats, first.bidirect, "logSumExp")(cropped(F.col("seq"), first.spat_min + 1, first.spat_max))
    rows = df.select("__parts", *responses, energies.alias("__e"))
    preds = [F.when(_in_part(k), m.through_grid(F.col("__e")[j])) for j, (m, k) in enumerate(models)]
    if binary:
        long = rows.select(F.col(responses[0]).alias("y"), F.inline(F.array(*(F.struct(F.lit(j).alias("fit"), p.alias("pred")) for j, p in enumerate(preds)))))
        found = {r.fit: r.D for r in ks_distance(long, "pred", "y", ["fit"], o.alternative).collect()}
        return [found.get(j) or 0.0 for j in range(len(models))]
    row = rows.agg(*(r_squared(p, F.col(c)).alias(f"s{j}_{i}") for j, p in enumerate(preds) for i, c in enumerate(responses))).first()
    return [float(np.mean([row[f"s{j}_{i}"] or 0.0 for i in range(len(responses))])) for j in range(len(models))]


def regress_together(df: DataFrame, parts: int, responses: list[str], o: Options, motif: str | np.ndarray | None = None, multi_kmers: bool = True) -> list[MotifModel]:
    """A model of each part of ``df`` (seq_id, seq, responses, __parts: a mask with a bit for each part), fitted in lock-step.

    Starts from the given k-mer or matrix or from k-mers screened on each part: every
    candidate is fitted on a training share, the best on the rest again on everything.
    """
    kept = df.is_cached  # by the caller
    df = df if kept else df.persist()
    try:
        length, binary, bases = _length_and_kind(df, responses)
        starts: list[str | np.ndarray] = [motif] * parts
        cands: list[list[str]] = [[] for _ in range(parts)]
        if motif is None:
            screen = lambda k: K.candidate_kmers(df.where(_in_part(k)).drop("__parts"), responses, list(o.kmer_lengths), o.min_gap, o.max_gap, o.min_kmer_cor, o.max_cands)
            with ThreadPoolExecutor(4) as pool:
                cands = list(pool.map(inheritable_thread_target(df.sparkSession)(screen), range(parts)))
            starts = [c[0] for c in cands]
        tried = [(kmer, k) for k in range(parts) for kmer in cands[k] if len(cands[k]) > 1 and multi_kmers]
        if tried:
            valid = F.pmod(F.xxhash64("seq_id", F.lit(o.seed)), F.lit(1000)) < int(1000 * o.val_frac)
            # A part without rows on either side trains and validates on all of its rows.
            sides = df.agg(*(F.count_if(_in_part(k) & side).alias(f"{s}{k}") for k in range(parts) for s, side in (("v", valid), ("t", ~valid)))).first()
            whole = sum(1 << k for k in range(parts) if not (sides[f"v{k}"] and sides[f"t{k}"]))
            both = F.col("__parts").bitwiseAND(F.lit(whole))
            train = df.withColumn("__parts", F.when(valid, both).otherwise(F.col("__parts"))).where("__parts <> 0")
            held = df.withColumn("__parts", F.when(valid, F.col("__parts")).otherwise(both)).where("__parts <> 0")
            models = fits_from(train, responses, tried, o, length, F.col("__parts"), bases=bases)
            scores = scores_together(held, [(m, k) for m, (_, k) in zip(models, tried)], responses, o, binary)
            for k in {k for _, k in tried}:
                starts[k] = max((score, kmer) for score, (kmer, own) in zip(scores, tried) if own == k)[1]
        models = fits_from(df, responses, list(zip(starts, range(parts))), o, length, F.col("__parts"), bases=bases)
        for k, m in enumerate(models):
            m.kmers = cands[k]
            m.consensus = _consensus(df, m, o)
        return models
    finally:
        if not kept:
            df.unpersist()


def _database(df: DataFrame, responses: list[str], model: MotifModel, motif_dataset: DataFrame | None, match_with_db: bool, screen_db: bool) -> MotifModel:
    """The model with its nearest motif of a data set, and the data set's best motif on the rows."""
    if motif_dataset is not None and match_with_db:
        hit = similarity.pssm_match(model.table(df.sparkSession), motif_dataset, "spearman").first()
        model.db_match = {"motif": hit.motif, "cor": hit.cor}
    if motif_dataset is not None and screen_db:
        hit = screen_pwm(df, responses, _library(motif_dataset), only_best=True).first()
        model.db_match |= {"screen_motif": hit.motif, "screen_score": hit.score}
    return model


def _dataset_start(df: DataFrame, responses: list[str], motif_dataset: DataFrame) -> np.ndarray:
    best = screen_pwm(df, responses, _library(motif_dataset), only_best=True).first().motif
    return np.array([[r.A, r.C, r.G, r.T] for r in motif_dataset.where(F.col("motif") == best).orderBy("pos").collect()])


def regress_pwm(df: DataFrame, responses: str | list[str], motif: str | np.ndarray | None = None, options: Options = Options(), motif_dataset: DataFrame | None = None, init_from_dataset: bool = False, multi_kmers: bool = True, match_with_db: bool = True, screen_db: bool = False) -> MotifModel:
    """Fits one motif to ``df`` (seq_id, seq, responses).

    Starts from the given k-mer or matrix, from the data set's best motif, or from
    screened k-mers: all candidates are fitted on a training part in lock-step, the
    best on the validation part is fitted again on everything.
    """
    responses = [responses] if isinstance(responses, str) else responses
    df = require_sequences(df)
    if motif is None and init_from_dataset and motif_dataset is not None:
        motif = _dataset_start(df, responses, motif_dataset)
    # Persisted here, so that the score is of the same rows and doesn't make them again.
    rows = df.select("seq_id", "seq", *responses, F.lit(1).cast("bigint").alias("__parts")).persist()
    try:
        model = regress_together(rows, 1, responses, options, motif, multi_kmers)[0]
        model = scored(rows, model, responses, options, is_binary(rows, responses))
        return _database(rows, responses, model, motif_dataset, match_with_db, screen_db)
    finally:
        rows.unpersist()


def _library(dataset: DataFrame) -> list[Motif]:
    from strandlab.operators.scoring import collect_motifs

    return collect_motifs(dataset)


def regress_pwm_sample(df: DataFrame, responses: str | list[str], sample_frac=None, sample_ratio: float = 1, options: Options = Options(), sample_ids: DataFrame | None = None, **kwargs) -> MotifModel:
    """Fits on a sample (even by class, matched by quantiles, or the rows named by ``sample_ids``: seq_id), scores on everything."""
    names = [responses] if isinstance(responses, str) else responses
    if sample_ids is not None:
        sample = df.join(sample_ids.select("seq_id").distinct(), "seq_id", "left_semi")
    else:
        sample = sampling.sample_response(df, names[0], sample_frac, sample_ratio, options.seed)
    model = regress_pwm(sample, names, options=options, **kwargs)
    return scored(df, model, names, options, is_binary(df, names))


def regress_pwm_clusters(df: DataFrame, cluster: str, options: Options = Options(), use_sample: bool = True, sample_frac=None, sample_ratio: float = 1, motif: str | np.ndarray | None = None, multi_kmers: bool = True, motif_dataset: DataFrame | None = None, match_with_db: bool = True, screen_db: bool = False) -> dict[str, MotifModel]:
    """A model of each cluster against the rest, fitted in lock-step; rows without a cluster belong to every rest.

    With ``use_sample`` each cluster is fitted on its own sample, then scored on everything.
    """
    df = require_sequences(df)
    names = sorted(r[0] for r in df.select(cluster).distinct().collect() if r[0] is not None)
    against = lambda c: df.select("seq_id", "seq", F.coalesce((F.col(cluster) == c).cast("int"), F.lit(0)).alias("__y"))
    out = {}
    for first in range(0, len(names), MOST_PARTS):
        group = names[first : first + MOST_PARTS]
        base = None
        for k, c in enumerate(group):
            rows = against(c)
            if use_sample:
                rows = sampling.sample_response(rows, "__y", sample_frac, sample_ratio, options.seed)
            rows = rows.withColumn("__parts", F.lit(1 << k).cast("bigint"))
            base = rows if base is None else base.unionByName(rows)
        models = regress_together(base, len(group), ["__y"], options, motif, multi_kmers)
        for c, model in zip(group, models):
            model = scored(against(c), model, ["__y"], options, True)
            out[c] = _database(against(c), ["__y"], model, motif_dataset, match_with_db, screen_db)
    return out


def regress_pwm_cv(df: DataFrame, responses: str | list[str], nfolds: int = 5, categories: str | None = None, options: Options = Options(), add_full_model: bool = True, folds: DataFrame | None = None, motif: str | np.ndarray | None = None, multi_kmers: bool = True) -> dict:
    """Fits without each fold, all in lock-step; returns models, held-out predictions (seq_id, fold, pred), pooled score and scores by fold.

    ``folds``: a table (seq_id, fold) of the caller's own instead; rows it doesn't name take no part.
    """
    names = [responses] if isinstance(responses, str) else responses
    df = require_sequences(df)
    if folds is not None:
        folded = df.drop("fold").join(folds.select("seq_id", "fold"), "seq_id").persist()
    else:
        folded = sampling.cv_folds(df, nfolds, categories, options.seed).persist()
    binary = is_binary(df, names)
    numbers = list(range(1, nfolds + 1)) if folds is None else sorted(r.fold for r in folds.select("fold").distinct().collect())
    models = []
    for first in range(0, len(numbers), MOST_PARTS):
        group = numbers[first : first + MOST_PARTS]
        mask = sum((F.when(F.col("fold") != k, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, k in enumerate(group)), F.lit(0).cast("bigint"))
        rows = folded.select("seq_id", "seq", *names, mask.alias("__parts"))
        models += regress_together(rows, len(group), names, options, motif, multi_kmers)
    preds, by_fold = None, []
    for k, model in zip(numbers, models):
        held = folded.where(F.col("fold") == k)
        by_fold.append(scored(held, model, names, options, binary).score)
        part = model.transform(held).select("seq_id", "fold", *names, "pred")
        preds = part if preds is None else preds.unionByName(part)
    if binary:
        pooled = ks_distance(preds.withColumn("__all", F.lit(0)), "pred", names[0], ["__all"], options.alternative).first().D
    else:
        pooled = float(np.mean([v or 0.0 for v in preds.agg(*(r_squared(F.col("pred"), F.col(c)) for c in names)).first()]))
    full = regress_pwm(df, names, motif, options, multi_kmers=multi_kmers) if add_full_model else None
    return {"models": models, "predictions": preds, "score": pooled, "by_fold": by_fold, "full_model": full}


@dataclass
class MultiModel:
    models: list[MotifModel]
    coefficients: np.ndarray  # (1 + models) x responses, the intercept first
    responses: list[str]
    stats: list[dict]

    def transform_multi(self, df: DataFrame) -> DataFrame:
        """``df`` with e1, e2, ...: each model's prediction."""
        for i, m in enumerate(self.models, 1):
            df = m.transform(df, f"e{i}")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with pred (or pred_<response> for several): the linear combination."""
        df = self.transform_multi(df)
        for j, name in enumerate(self.responses):
            value = F.lit(float(self.coefficients[0, j]))
            for i in range(len(self.models)):
                value = value + F.lit(float(self.coefficients[i + 1, j])) * F.col(f"e{i + 1}")
            df = df.withColumn("pred" if len(self.responses) == 1 else f"pred_{name}", value)
        return df.drop(*(f"e{i + 1}" for i in range(len(self.models))))


def regress_multiple_motifs(df: DataFrame, responses: str | list[str], motif_num: int = 2, smooth_k: int = 100, options: Options = Options(), energy_func_generator: Callable | None = None, **kwargs) -> MultiModel:
    """Motif after motif: each fits what the response leaves after a running mean over the combined prediction."""
    names = [responses] if isinstance(responses, str) else responses
    _, binary, bases = _length_and_kind(df, names)
    models, stats, current = [], [], df
    previous = None
    for i in range(1, motif_num + 1):
        targets = names if i == 1 else [f"__res_{n}" for n in names]
        model = regress_pwm(current, targets, options=options, **kwargs)
        if energy_func_generator is not None:
            again = replace(options, energy_func=energy_func_generator(model, current, targets), spat_model=model.spat)
            other = scored(current, fit_from(current, targets, model.pssm, again, _length(current)), targets, again, binary and i == 1)
            model = other if other.score > model.score else model
        models.append(model)
        fitted = df
        for j, m in enumerate(models, 1):
            fitted = m.transform(fitted, f"e{j}")
        features = [f"e{j}" for j in range(1, i + 1)]
        multi = MultiModel(list(models), least_squares(fitted, features, names), names, [])
        score, combined = _multi_scores(fitted, multi, f"e{i}", names, binary, options)
        stats.append({"model": i, "score": score, "comb_score": combined, "diff": None if previous is None else combined - previous, "consensus": model.consensus, "seed_motif": model.seed_motif, **({"db_match": model.db_match.get("motif"), "db_match_cor": model.db_match.get("cor")} if model.db_match else {})})
        previous = combined
        if i < motif_num:
            current = multi.transform(df)
            order = F.col("pred") if len(names) == 1 else sum((F.col(f"pred_{n}") for n in names[1:]), F.col(f"pred_{names[0]}"))
            current = current.withColumn("__e", order)
            for n in names:
                current = running_mean(current, "__e", n, smooth_k, out_col=f"__smooth_{n}").withColumn(f"__res_{n}", F.col(n) - F.col(f"__smooth_{n}"))
            # A running mean leaves a few large ranges, which the next screen and fit would read with as many cores.
            current = current.select("seq_id", "seq", *(f"__res_{n}" for n in names)).repartition(even_tasks(df, -(-bases // TASK_BASES)))
    return MultiModel(models, multi.coefficients, names, stats)


def _multi_scores(fitted: DataFrame, multi: MultiModel, own: str, names: list[str], binary: bool, o: Options) -> tuple[float, float]:
    combined = multi.transform(fitted.select("seq_id", "seq", *names, F.col(own).alias("__own")))
    if binary:
        whole = combined.withColumn("__all", F.lit(0))
        return tuple((ks_distance(whole, c, names[0], ["__all"], o.alternative).first().D or 0.0) for c in ("__own", "pred"))
    cols = ["pred"] if len(names) == 1 else [f"pred_{n}" for n in names]
    row = combined.agg(*(r_squared(F.col("__own"), F.col(n)) for n in names), *(r_squared(F.col(c), F.col(n)) for c, n in zip(cols, names))).first()
    values = [v or 0.0 for v in row]
    return float(np.mean(values[: len(names)])), float(np.mean(values[len(names) :]))


def interpolated(value: Column, x: list[float], y: list[float]) -> Column:
    """Linear interpolation in a table (clamped), as a Column."""
    xs, ys = (F.array(*(F.lit(float(v)) for v in g)) for g in (x, y))
    k = F.size(F.filter(xs, lambda b: b <= value))
    inside = F.get(ys, k - 1) + (F.get(ys, k) - F.get(ys, k - 1)) * (value - F.get(xs, k - 1)) / (F.get(xs, k) - F.get(xs, k - 1))
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= F.size(xs), F.get(ys, F.size(xs) - 1)).otherwise(inside)


def bits_of(pssm: np.ndarray) -> np.ndarray:
    return np.array([max(0.0, 2 + sum(p * math.log2(p) for p in row if p > 0)) for row in pssm])
