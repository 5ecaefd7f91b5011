"""Scoring sequences against motifs: total, maximum and per-position energies.

The energy of a sequence is the log of the sum over windows and strands of the
product of base probabilities and the spatial factor of the window's bin. The
kernel is an Arrow-vectorised function: sequences of one length in a batch are one
matrix, motif columns are gathered by base code. A whole library is scored in one
pass; its arrays travel as a broadcast whose size is checked.

A library of several motifs is scored by tables of short words: a window's
probability in all motifs is the product of a few rows of tables. Local energies
are computed over the bases of many sequences at once, in slices of ``BASES``.

Conventions: windows are all that fit; a sequence shorter than the motif gives
null. In ``compute_pwm`` and local energies unknown letters take the column's mean
log probability on the forward strand and log(1/4) on the reverse strand; in
``extract_pwm`` and ``score_matrix`` a sequence with an unknown letter gives null. Windows beyond the last spatial bin are
skipped. Ranges are per row, from 1, both ends inclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from strandlab.functions.sequence import CODES

LOG_QUARTER = -1.38629
COMPLEMENT = [3, 2, 1, 0]
#: Motif libraries above this many rows are refused as a broadcast.
MAX_MOTIF_ROWS = 1_000_000
LETTERS = ["A", "C", "G", "T"]
#: Bases of the sequences whose local energies are computed at once.
BASES = 1 << 18
#: Letters of a word in the tables of a library, motifs that share tables, bytes of a block of products.
WORD, COLUMNS, PRODUCT = 4, 32, 1 << 20
#: Letters of a word in the tables of the native form (5 to that power places).
NATIVE = 6
#: Bases whose windows are summed at once.
FLAT = 1 << 16
#: From so many motifs of one length on tables of words are the faster way.
LIBRARY = 4


@dataclass(frozen=True)
class Spatial:
    """Equal-width bins of factors over window starts."""

    factors: tuple[float, ...] = (1.0,)
    bin_size: int | None = None

    def __post_init__(self):
        if any(f < 0 for f in self.factors):
            raise ValueError("spatial factors must not be negative")
        if self.bin_size is not None and self.bin_size <= 0:
            raise ValueError("the bin size must be positive")

    def log_factors(self, windows: int) -> np.ndarray:
        if self.bin_size is None:
            return np.zeros(windows)
        bins = np.arange(windows) // self.bin_size
        with np.errstate(divide="ignore"):
            logs = np.log(np.asarray(self.factors, float))
        return np.where(bins < len(logs), logs[np.minimum(bins, len(logs) - 1)], -np.inf)


@dataclass(frozen=True)
class Motif:
    name: str
    forward: np.ndarray  # length x 5 log probabilities, the last for unknown letters
    reverse: np.ndarray

    @classmethod
    def of(cls, name: str, weights: np.ndarray, prior: float = 0.01, normalise_first: bool = True) -> Motif:
        if not 0 <= prior <= 1:
            raise ValueError("prior should be between 0 and 1")
        p = np.asarray(weights, float)
        if p.ndim != 2 or p.shape[1] != 4 or not len(p):
            raise ValueError("a motif needs at least one row of A, C, G, T")
        if normalise_first:
            p = p / p.sum(axis=1, keepdims=True)
        p = p + prior
        p = p / p.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            logs = np.maximum(np.log(p), -3.4028235e36)
        forward = np.column_stack([logs, logs.mean(axis=1)])
        reverse = np.column_stack([logs[::-1][:, COMPLEMENT], np.full(len(p), LOG_QUARTER)])
        return cls(name, forward, reverse)

    def __len__(self) -> int:
        return len(self.forward)


def collect_motifs(motifs: DataFrame, prior: float = 0.01, normalise_first: bool = True) -> list[Motif]:
    """The motifs of a tidy table, by name; the table must have a bounded number of rows."""
    rows = motifs.select("motif", "pos", *LETTERS).limit(MAX_MOTIF_ROWS + 1).collect()
    if len(rows) > MAX_MOTIF_ROWS:
        raise ValueError(f"more than {MAX_MOTIF_ROWS} motif rows; score the library in parts")
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.motif, r.pos)):
        by.setdefault(r.motif, []).append([r.A, r.C, r.G, r.T])
    return [Motif.of(name, np.array(p), prior, normalise_first) for name, p in by.items()]


def encode(seqs: list[str]) -> np.ndarray:
    """Sequences of one length as a matrix of codes."""
    return CODES[np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8).reshape(len(seqs), -1)]


def window_scores(codes: np.ndarray, motif: Motif, spat: Spatial, bidirect: bool) -> list[np.ndarray]:
    """Per strand, sequences x windows of log probability plus log spatial factor."""
    windows = codes.shape[1] - len(motif) + 1
    out = []
    for table in (motif.forward, motif.reverse) if bidirect else (motif.forward,):
        s = np.zeros((len(codes), windows)) + spat.log_factors(windows)
        for j in range(len(motif)):
            s += table[j][codes[:, j : j + windows]]
        out.append(s)
    return out


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[:, None]).sum(axis=1))


def energies(codes: np.ndarray, motif: Motif, spat: Spatial, bidirect: bool, func: str) -> np.ndarray:
    tables = (motif.forward, motif.reverse) if bidirect else (motif.forward,)
    if func != "max" and min(t.min(axis=1).sum() for t in tables) > -600:
        return _summed_energies(codes, tables, spat)
    scores = window_scores(codes, motif, spat, bidirect)
    if func == "max":
        return (np.logaddexp(*scores) if bidirect else scores[0]).max(axis=1)
    return log_sum(np.concatenate(scores, axis=1))


def _summed_energies(codes: np.ndarray, tables: tuple[np.ndarray, ...], spat: Spatial) -> np.ndarray:
    """Total energies by tables of words, for motifs that can't underflow; the sequences' bases stand one after another."""
    n, width = codes.shape
    length = len(tables[0])
    weight = np.zeros(width)  # windows that reach into the next sequence count nothing
    weight[: width - length + 1] = np.exp(spat.log_factors(width - length + 1))
    cuts = [(j, min(j + WORD, length)) for j in range(0, length, WORD)]
    words = [[_word_table([t[a:b]]).ravel() for a, b in cuts] for t in tables]
    out = np.empty(n)
    step = max(1, FLAT // width)
    for k in range(0, n, step):
        part = codes[k : k + step]
        flat = np.zeros(part.size + length, np.uint8)
        flat[: part.size] = part.ravel()
        at = {q: _words(flat[None], q)[0] for q in {b - a for a, b in cuts}}
        total = 0
        for table in words:
            prod = None
            for (a, b), word in zip(cuts, table):
                own = word.take(at[b - a][a : a + part.size])
                prod = own if prod is None else np.multiply(prod, own, out=prod)
            total = total + prod.reshape(-1, width) @ weight
        with np.errstate(divide="ignore"):
            out[k : k + step] = np.log(total)
    return out


def library_energies(codes: np.ndarray, motifs: list[Motif], spats: list[Spatial], bidirect: bool, func: str) -> np.ndarray:
    """Sequences x motifs, for motifs of one length that fits.

    Motifs are cut into words of ``WORD`` letters; a table holds each word's
    probability in each motif (words x motifs, both strands), so a window's
    probability in all motifs is the product of a few table rows.
    """
    n, width = codes.shape
    length, windows = len(motifs[0]), width - len(motifs[0]) + 1
    if min(np.where(t > -1e30, t, 0).min(axis=1).sum() for m in motifs for t in (m.forward, m.reverse)) < -690:
        return np.stack([energies(codes, m, s, bidirect, func) for m, s in zip(motifs, spats)], axis=1)  # may underflow
    out = np.empty((n, len(motifs)))
    cuts = [(j, min(j + WORD, length)) for j in range(0, length, WORD)]
    words = {q: _words(codes, q) for q in {b - a for a, b in cuts}}
    plain = all(s.bin_size is None for s in spats)
    strands = 2 if bidirect else 1
    for k in range(0, len(motifs), COLUMNS):
        part = motifs[k : k + COLUMNS]
        tables = [_word_table([m.forward[a:b] for m in part] + [m.reverse[a:b] for m in part][: len(part) * (strands - 1)]) for a, b in cuts]
        factors = None if plain else np.tile(np.exp(np.stack([s.log_factors(windows) for s in spats[k : k + COLUMNS]], axis=1)), strands)
        size = max(1, PRODUCT // (8 * tables[0].shape[1]))  # windows of a block
        rows, many = max(1, size // windows), min(size, windows)
        for r in range(0, n, rows):
            total = np.zeros((min(rows, n - r), len(part)))
            for w in range(0, windows, many):
                end = min(w + many, windows)
                product = None
                for (a, b), table in zip(cuts, tables):
                    own = table.take(words[b - a][r : r + rows, w + a : end + a].ravel(), axis=0)
                    product = own if product is None else np.multiply(product, own, out=product)
                product = product.reshape(len(total), end - w, -1)
                if factors is not None:
                    product *= factors[None, w:end]
                if func == "max":
                    both = product[:, :, : len(part)] + product[:, :, len(part) :] if bidirect else product
                    total = np.maximum(total, both.max(axis=1))
                else:
                    sums = product.sum(axis=1)
                    total += sums[:, : len(part)] + sums[:, len(part) :] if bidirect else sums
            with np.errstate(divide="ignore"):
                out[r : r + rows, k : k + COLUMNS] = np.log(total)
    return out


def _words(codes: np.ndarray, length: int) -> np.ndarray:
    """The number, to the base 5, of the word that begins at each position."""
    many = codes.shape[1] - length + 1
    out = np.zeros((len(codes), many), np.int64)
    for j in range(length):
        out *= 5
        out += codes[:, j : j + many]
    return out


def _word_table(logs: list[np.ndarray]) -> np.ndarray:
    """Words x motifs: the product of a word's probabilities."""
    table = np.zeros((1, len(logs)))
    for j in range(len(logs[0])):
        table = (table[:, None] + np.stack([t[j] for t in logs], axis=1)[None]).reshape(-1, len(logs))
    return np.exp(table)


def by_length(seqs: pd.Series, shortest: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) for each length in the batch."""
    texts = seqs.to_numpy(object)
    lengths = np.fromiter((-1 if s is None else len(s) for s in texts), np.int64, len(texts))
    for n in np.unique(lengths):
        if n >= shortest:
            at = np.flatnonzero(lengths == n)
            # Bounded slices keep the score matrices small for long sequences.
            step = max(1, int(4_000_000 // n))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                yield part, encode(texts[part].tolist())


def cropped(seq: Column, spat_min: int | None, spat_max: int | None) -> Column:
    if (spat_min or 1) <= 1 and spat_max is None:
        return seq
    first = max(1, spat_min or 1)
    return F.substring(seq, first, 2**31 - 1 if spat_max is None else max(0, spat_max - first + 1))


def scorer(df: DataFrame, motifs: list[Motif], spat: dict[str, Spatial] | Spatial, bidirect: bool, func: str, unknown: str = "mean"):
    """A function from a sequence column to an array: the energy of each motif. ``unknown``: mean or null, for letters but A, C, G, T."""
    if func not in ("logSumExp", "max"):
        raise ValueError("func should be either max or logSumExp")
    shared = df.sparkSession.sparkContext.broadcast((motifs, spat if isinstance(spat, dict) else {m.name: spat for m in motifs}))

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, spats = shared.value
        groups: dict[int, list[int]] = {}
        for k, m in enumerate(own):
            groups.setdefault(len(m), []).append(k)
        for batch in batches:
            seqs = pd.Series(batch.to_pylist(), dtype=object)
            out = np.full((len(seqs), len(own)), np.nan)
            for at, codes in by_length(seqs):
                if unknown == "null":
                    known = (codes < 4).all(axis=1)
                    at, codes = at[known], codes[known]
                for length, members in groups.items():
                    if codes.shape[1] < length or not len(at):
                        continue
                    if len(members) >= LIBRARY:
                        out[np.ix_(at, members)] = library_energies(codes, [own[k] for k in members], [spats.get(own[k].name, Spatial()) for k in members], bidirect, func)
                        continue
                    for k in members:
                        out[at, k] = energies(codes, own[k], spats.get(own[k].name, Spatial()), bidirect, func)
            out[np.isneginf(out)] = np.nan
            yield _lists(out.ravel(), np.full(len(out), len(own)), pa.float64(), np.zeros(len(out), bool))

    return score


def compute_pwm(df: DataFrame, motif: Motif, spat: Spatial = Spatial(), spat_min: int | None = 1, spat_max: int | None = None, bidirect: bool = True, func: str = "logSumExp", out_col: str = "pwm") -> DataFrame:
    """``df`` with the energy of each ``seq``."""
    score = scorer(df, [motif], spat, bidirect, func)
    return df.withColumn(out_col, score(cropped(F.col("seq"), spat_min, spat_max))[0])


def extract_pwm(df: DataFrame, motifs: list[Motif], spat: Spatial | dict[str, Spatial] = Spatial(), spat_min: int | None = 1, spat_max: int | None = None, bidirect: bool = True, func: str = "logSumExp", id_cols: list[str] | None = None) -> DataFrame:
    """Long scores (id columns, motif, pwm) of every sequence against every motif; one stage, no shuffle. A sequence with an unknown letter has no score."""
    ids = id_cols or ["seq_id"]
    score = scorer(df, motifs, spat, bidirect, func, "null")
    names = F.array(*(F.lit(m.name) for m in motifs))
    wide = df.select(*ids, score(cropped(F.col("seq"), spat_min, spat_max)).alias("__s"))
    return wide.select(*ids, F.inline(F.arrays_zip(names.alias("motif"), F.col("__s").alias("pwm")))).toDF(*ids, "motif", "pwm")


def score_matrix(df: DataFrame, motifs: list[Motif], id_cols: list[str] | None = None, **options) -> DataFrame:
    """Wide scores: one column per motif."""
    ids = id_cols or ["seq_id"]
    score = scorer(df, motifs, options.pop("spat", Spatial()), options.pop("bidirect", True), options.pop("func", "logSumExp"), "null")
    wide = df.select(*ids, score(cropped(F.col("seq"), options.pop("spat_min", 1), options.pop("spat_max", None))).alias("__s"))
    return wide.select(*ids, *(F.col("__s")[i].alias(m.name) for i, m in enumerate(motifs)))


def local_energies(seqs: pa.Array, motif: Motif, spat: Spatial, bidirect: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first sequence, ends of the sequences, energies of all their positions; NaN where no window fits), in slices.

    A slice holds sequences of ``BASES`` bases in all, or one longer sequence. Their
    bases stand one after another; windows that cross from one to the next don't count.
    """
    upto = np.cumsum(pc.fill_null(pc.utf8_length(seqs), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(upto):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + BASES, side="right")))
        ends = upto[first:last] - before
        lengths = np.diff(ends, prepend=0)
        texts = (t for t in seqs.slice(first, last - first).to_pylist() if t)  # of a slice only: a batch of long texts may be large
        codes = CODES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]
        out = np.full(len(codes), np.nan)
        for a in range(0, len(codes) - len(motif) + 1, BASES):
            part = codes[a : a + BASES + len(motif) - 1]
            windows = len(part) - len(motif) + 1
            sums = []
            for table in (motif.forward, motif.reverse) if bidirect else (motif.forward,):
                s = table[0][part[:windows]]
                for j in range(1, len(motif)):
                    s += table[j][part[j : j + windows]]
                sums.append(s)
            out[a : a + windows] = np.logaddexp(*sums) if bidirect else sums[0]
        if spat.bin_size is not None:
            for begin, n in zip(ends - lengths, lengths):
                out[begin : begin + n] += spat.log_factors(n)
        for j in range(1, len(motif)):  # the last positions of each sequence
            out[np.maximum(ends - j, ends - lengths)[lengths > 0]] = np.nan
        out[np.isneginf(out)] = np.nan
        yield first, ends, out
        first = last


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, missing: np.ndarray) -> pa.Array:
    """Lists of ``counts`` values each; null where ``missing``, null values where NaN."""
    flat = pa.array(values, kind, mask=np.isnan(values) if values.dtype.kind == "f" else None)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), flat)


def compute_local_pwm(df: DataFrame, motif: Motif, spat: Spatial = Spatial(), bidirect: bool = True, out_col: str = "local") -> DataFrame:
    """``df`` with an array: the energy of the window at each position, null where none fits.

    Rows leave in slices of ``BASES`` positions, however many a batch brings.
    """
    shared = df.sparkSession.sparkContext.broadcast(motif)
    df = df.drop(out_col)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq")
            for first, ends, values in local_energies(seqs, shared.value, spat, bidirect):
                part = batch.slice(first, len(ends))
                missing = np.asarray(part.column("seq").is_null())
                lists = _lists(values, np.diff(ends, prepend=0), pa.float64(), missing)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, out_col])

    return df.mapInArrow(local, StructType([*df.schema.fields]).add(out_col, ArrayType(DoubleType())))


_OPERATORS = {
    ">": lambda x, t: x > t,
    "<": lambda x, t: x < t,
    ">=": lambda x, t: x >= t,
    "<=": lambda x, t: x <= t,
    "==": lambda x, t: np.abs(x - t) < 1e-10,
}


def screen_local_pwm(df: DataFrame, motif: Motif, operator: str, threshold: float, spat: Spatial = Spatial(), bidirect: bool = True, out_col: str = "positions") -> DataFrame:
    """``df`` with the positions, from 1, whose local energy meets the condition; energies don't leave the kernel."""
    if operator not in _OPERATORS:
        raise ValueError(f"operator must be one of {', '.join(_OPERATORS)}")
    shared = df.sparkSession.sparkContext.broadcast(motif)

    @F.arrow_udf("array<int>")
    def screen(seqs: pa.Array) -> pa.Array:
        found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, ends, values in local_energies(seqs, shared.value, spat, bidirect):
            hit = np.flatnonzero(_OPERATORS[operator](values, threshold))
            own = np.searchsorted(ends, hit, side="right")
            begin = np.concatenate([[0], ends[:-1]])
            found.append((hit - begin[own] + 1).astype(np.int32))
            counts.append(np.bincount(own, minlength=len(ends)))
        return _lists(np.concatenate(found), np.concatenate(counts), pa.int32(), np.asarray(seqs.is_null()))

    return df.withColumn(out_col, screen("seq"))


def best_position(df: DataFrame, motif: Motif, spat: Spatial = Spatial(), bidirect: bool = True, out_col: str = "best") -> DataFrame:
    """``df`` with the first position, from 1, of the highest local energy (equal within 1e-9)."""
    shared = df.sparkSession.sparkContext.broadcast(motif)

    @F.arrow_udf("int")
    def best(seqs: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for _, ends, values in local_energies(seqs, shared.value, spat, bidirect):
            for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends):
                own = values[begin:end].round(9)
                fits = ~np.isnan(own)
                out.append(int(np.flatnonzero(own == own[fits].max())[0]) + 1 if fits.any() else None)
        return pa.array(out, pa.int32())

    return df.withColumn(out_col, best("seq"))


def mask_sequences(df: DataFrame, motif: Motif, mask_thresh: float, informative: list[bool], bidirect: bool = True, out_col: str = "masked") -> DataFrame:
    """``df`` with N at the informative positions of every window above the threshold.

    The last window is never scored and the last ``len(motif)`` bases are always
    masked; a sequence shorter than the motif is masked whole.
    """
    shared = df.sparkSession.sparkContext.broadcast((motif, np.array(informative, bool)))

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, where = shared.value
        for seqs in batches:
            seqs = seqs.map(lambda s: None if s is None else s.upper())
            out: list = [None if s is None else "N" * len(s) for s in seqs]
            for at, codes in by_length(seqs, len(m)):
                s = window_scores(codes, m, Spatial(), bidirect)
                hit = (np.logaddexp(*s) if bidirect else s[0])[:, :-1] > mask_thresh
                gone = np.zeros(codes.shape, bool)
                gone[:, codes.shape[1] - len(m) :] = True
                for k in np.flatnonzero(where):
                    gone[:, k : k + hit.shape[1]] |= hit
                for i, g in zip(at, gone):
                    b = np.frombuffer(seqs.iat[i].encode("latin-1", "replace"), np.uint8).copy()
                    b[g] = ord("N")
                    out[i] = b.tobytes().decode("latin-1")
            yield pd.Series(out)

    return df.withColumn(out_col, mask("seq"))


def native_energy(seq: Column, motif: Motif, bidirect: bool = True) -> Column:
    """The same total energy from Spark's own functions alone, for places without Python workers.

    Letters become the digits 0 to 4; the numbers, to the base 5, of the words of
    ``NATIVE`` letters that begin at each position are found by joining neighbours and
    are the places in tables of probabilities. A window's probability is the product
    of a few places. Motifs that may underflow are summed by logs, letter by letter.
    """
    length = len(motif)
    tables = [motif.forward, motif.reverse] if bidirect else [motif.forward]
    # Each unknown letter is one digit, so that positions stay.
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGTN", "01234")
    codes = F.split(digits, "").cast("array<int>")
    if min(t.min(axis=1).sum() for t in tables) <= -600:
        return F.when(F.length(seq) >= length, _energy_by_logs(codes, tables))
    size = min(NATIVE, length)
    # The last word begins earlier where it would be short; letters counted before count nothing in it.
    starts = [*range(0, length - size, size), length - size]
    seen = [0, *(a + size - b for a, b in zip(starts, starts[1:]))]
    if len(starts) == 1:
        places = [[_place(sum(_probabilities(t, 0, size, 0) for t in tables))]]
    else:
        places = [[_place(_probabilities(t, at, size, n)) for at, n in zip(starts, seen)] for t in tables]

    def lengthened(more: int):
        """A function from the words to those with ``more`` letters of the word ``more`` places on."""

        def step(words: Column) -> Column:
            count = F.size(words) - F.lit(more)
            return F.zip_with(F.slice(words, F.lit(1), count), F.slice(words, F.lit(more + 1), count), lambda a, b: a * (5**more) + b % (5**more))

        return step

    def product(table: list[Column], at: list[Column]) -> Column:
        out = F.get(table[0], at[0])
        for column, word in zip(table[1:], at[1:]):
            out = out * F.get(column, word)
        return out

    def scored(words: Column) -> Column:
        if len(starts) == 1:
            return F.ln(F.aggregate(words, F.lit(0.0), lambda total, word: total + F.get(places[0][0], word)))

        def add(total: Column, i: Column) -> Column:
            for table in places:
                total = total + product(table, [F.get(words, i + s) for s in starts])
            return total

        return F.ln(F.aggregate(F.sequence(F.lit(0), F.size(words) - F.lit(starts[-1] + 1)), F.lit(0.0), add))

    # Inside an array of one each step is computed once, not for each window.
    steps, span = F.array(codes), 1
    while span < size:
        more = min(span, size - span)
        steps = F.transform(steps, lengthened(more))
        span += more
    return F.when(F.length(seq) >= length, F.transform(steps, scored)[0])


def _probabilities(logs: np.ndarray, at: int, size: int, seen: int) -> np.ndarray:
    """The probability of each word of ``size`` letters at ``at``; its first ``seen`` letters count nothing."""
    rows = logs[at : at + size].copy()
    rows[:seen] = 0
    return _word_table([rows]).ravel()


def _place(values: np.ndarray) -> Column:
    """An array literal: Spark folds the cast of one string once, where many literals would each be a call."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def _energy_by_logs(codes: Column, tables: list[np.ndarray]) -> Column:
    columns = [[F.array(*(F.lit(float(v)) for v in row)) for row in t] for t in tables]

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(codes) - len(tables[0]))
        per = [F.transform(starts, _window_score(codes, t)) for t in columns]
        return F.concat(*per) if len(per) > 1 else per[0]

    def reduced(scores: Column) -> Column:
        # Inside an array of one the largest is found once, not for each score.
        return F.transform(F.array(F.array_max(scores)), lambda top: F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top), lambda a: F.ln(a) + top))[0]

    return F.transform(F.transform(F.array(codes), windows), reduced)[0]


def _window_score(codes: Column, table: list[Column]):
    def score(i: Column) -> Column:
        terms = [F.get(row, F.get(codes, i + j)) for j, row in enumerate(table)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return score
