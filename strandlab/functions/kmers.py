"""k-mers: generation, counting, screening against responses, composition.

Sequences are DataFrames with ``seq_id`` and ``seq``. Counting happens inside the
row (an Arrow kernel, or sorted windows and run lengths), so a k-mer matrix needs no
shuffle and a screen shuffles once, on the k-mer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.sequence import require_sequences

MOST_COUNTED = 19


def generate_kmers(kmer_length: int, max_gap: int = 0, min_gap: int = 0, compat: bool = False) -> list[str]:
    """All k-mers (first letter fastest, order T, C, G, A), then those with a run of min_gap..max_gap N.

    ``compat`` keeps the repetitions that a positive ``min_gap`` yields.
    """
    if kmer_length < 1:
        raise ValueError("kmer_length must be greater than 0")
    if min_gap < 0 or max_gap < 0:
        raise ValueError("gaps must be greater than or equal to 0")
    if max_gap > kmer_length:
        raise ValueError("max_gap must be less than or equal to kmer_length")
    if max_gap < min_gap:
        raise ValueError("max_gap must be greater than or equal to min_gap")
    plain = ["".join(reversed(p)) for p in product("TCGA", repeat=kmer_length)]
    gapped = [k[:pos] + "N" * g + k[pos + g :] for g in range(min_gap, max_gap + 1) for pos in range(kmer_length - g + 1) for k in plain]
    if min_gap > 0:
        return gapped if compat else list(dict.fromkeys(gapped))
    return list(dict.fromkeys(plain + gapped))


def kmers_frame(spark: SparkSession, kmer_length: int, max_gap: int = 0, min_gap: int = 0) -> DataFrame:
    """The same set of k-mers as a column, by cross joins of the alphabet (no driver list)."""
    df = spark.range(1).select(F.lit("").alias("kmer"))
    for _ in range(kmer_length):
        df = df.select("kmer", F.explode(F.array(*map(F.lit, "TCGA"))).alias("c")).select(F.concat("c", "kmer").alias("kmer"))
    runs = [(pos, g) for g in range(max(min_gap, 1), max_gap + 1) for pos in range(kmer_length - g + 1)]
    k = F.col("kmer")
    forms = ([k] if min_gap == 0 else []) + [_with_run(k, pos, g) for pos, g in runs]
    return df.select(F.explode(F.array(*forms)).alias("kmer")).distinct()


def _with_run(kmer: Column, pos: int, g: int) -> Column:
    return F.concat(F.substring(kmer, 1, pos), F.lit("N" * g), F.substring(kmer, pos + g + 1, 2**31 - 1))


def _gapped(windows: Column, k1: int, g: int, k2: int) -> Column:
    return F.transform(windows, lambda w: F.concat(F.substring(w, 1, k1), F.lit("*" * g), F.substring(w, k1 + g + 1, k2)))


def _windows(seq: Column, k: int, first: Column, last: Column) -> Column:
    """Substrings of length k that begin at first..last (from 1); the letters are split once, so the work follows the length."""
    starts = F.sequence(first, F.greatest(first, last))
    some = F.transform(F.array(F.split(seq, "")), lambda c: F.transform(starts, lambda i: F.array_join(F.slice(c, i.cast("int"), F.lit(k)), "")))[0]
    return F.when(last >= first, some).otherwise(F.array().cast("array<string>"))


def _run_lengths(items: Column) -> Column:
    """array<struct<kmer, n>> of a sorted array."""
    size = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (size > 0) & ((i == 0) | (F.get(items, i) != F.get(items, i - 1))))
    counted = lambda s: F.transform(s, lambda i, j: F.struct(F.get(items, i).alias("kmer"), (F.coalesce(F.get(s, j + 1), size) - i).alias("n")))
    return F.transform(F.array(starts), counted)[0]  # the array of one keeps the starts from being computed per item


def kmer_counts(df: DataFrame, kmer_length: int, max_gap: int = 0, mask: str | None = None, add_mask: bool = False, from_range: int = 1, to_range: int | None = None, compat: bool = False) -> DataFrame:
    """(seq_id, kmer, n) of the k-mers that begin in the range.

    ``mask``: letters N blank their position (a mask without N is ignored, one with N
    takes precedence over gaps); ``add_mask`` keeps the plain k-mers too. ``compat``
    lets the range reach one base further, as the original does.
    """
    blank = [i for i, c in enumerate(mask or "") if c == "N"]
    if blank:
        forms = ([[]] if add_mask else []) + [blank]
    else:
        forms = [[]] + [list(range(pos, pos + g)) for g in range(1, max_gap + 1) for pos in range(kmer_length - g + 1)]
    most = None if to_range is None else to_range + (1 if compat else 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kmers, counts = [], [], []
            for i, seq in enumerate(batch.column("seq")):
                found, n = _counted((seq.as_py() or "").upper()[:most], kmer_length, from_range - 1, forms)
                ids.append(np.full(len(n), i))
                kmers.append(found)
                counts.append(n)
            at = np.concatenate([np.zeros(0, np.int64), *ids])
            yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, f"U{kmer_length}"), *kmers]).tolist(), pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], names=["seq_id", "kmer", "n"])

    return df.select("seq_id", "seq").mapInArrow(count, f"seq_id {dict(df.dtypes)['seq_id']}, kmer string, n bigint")


def _counted(seq: str, k: int, first: int, forms: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-mers that begin at ``first`` (from 0) or later, with their counts; each form blanks its positions."""
    letters = np.frombuffer(seq[first:].encode("utf-32-le"), np.uint32)
    if len(letters) < k:
        return np.zeros(0, f"U{k}"), np.zeros(0, np.int64)
    alphabet, codes = np.unique(np.append(letters, ord("N")), return_inverse=True)
    codes, blank = codes[:-1].astype(np.uint64), np.uint64(codes[-1])
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * k > 64:  # many letters or long k-mers: strings
        windows = np.lib.stride_tricks.sliding_window_view(letters, k)
        parts = []
        for form in forms:
            w = windows.copy()
            w[:, form] = ord("N")
            parts.append(w.view(f"U{k}").ravel())
        return np.unique(np.concatenate(parts), return_counts=True)
    shift = [np.uint64(bits * (k - 1 - j)) for j in range(k)]
    parts = []
    for form in forms:
        w = np.zeros(len(codes) - k + 1, np.uint64)
        for j in range(k):
            w |= (blank if j in form else codes[j : j + len(w)]) << shift[j]
        parts.append(w)
    packed, n = np.unique(np.concatenate(parts), return_counts=True)
    rows = np.stack([alphabet[((packed >> s) & np.uint64(2**bits - 1)).astype(np.int64)] for s in shift], axis=1)
    return np.ascontiguousarray(rows.astype(np.uint32)).view(f"U{k}").ravel(), n


def kmer_matrix(df: DataFrame, kmer_length: int, kmers: list[str], **options) -> DataFrame:
    """Wide counts for a stated list of k-mers, zeros included; rows of one ``seq_id`` have the sums of all of them.

    Plain k-mers are counted in the row, so what is shuffled is a row for each sequence.
    """
    if options:
        counts = kmer_counts(df, kmer_length, **options).where(F.col("kmer").isin(kmers))
        wide = counts.groupBy("seq_id").agg(*(F.sum(F.when(F.col("kmer") == k, F.col("n"))).alias(k) for k in kmers))
        return df.select("seq_id").join(wide, "seq_id", "left").fillna(0, kmers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").upper() for t in batch.column("seq").to_pylist()]
            # Sequences one after another with a break between them: windows across it match nothing.
            text = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)
            row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
            columns = []
            for k in kmers:
                hit = np.ones(max(0, len(text) - kmer_length + 1) if len(k) == kmer_length else 0, bool)
                for j, c in enumerate(k if len(hit) else ""):
                    hit &= text[j : j + len(hit)] == ord(c)
                columns.append(pa.array(np.bincount(row[: len(hit)][hit], minlength=len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), *columns], names=["seq_id", *kmers])

    quoted = [f"`{k}`" for k in kmers]
    counted = df.select("seq_id", "seq").mapInArrow(count, ", ".join([f"seq_id {dict(df.dtypes)['seq_id']}", *(f"{k} bigint" for k in quoted)]))
    total = lambda k: F.when(F.col("seq_id").isNull(), F.lit(0)).otherwise(F.sum(k))
    wide = counted.groupBy("seq_id").agg(F.count(F.lit(1)).cast("int").alias("__rows"), *(total(q).cast("bigint").alias(k) for k, q in zip(kmers, quoted)))
    return wide.select("seq_id", *quoted, F.explode(F.array_repeat(F.lit(0), F.col("__rows"))).alias("__row")).drop("__row")


def screen_patterns(seq: Column, kmer_length: int, min_gap: int, max_gap: int, from_range: Column, to_range: Column) -> Column:
    """All (gapped) patterns of a sequence; starts reach to_range - k - max_gap, from 0, for every gap."""
    first, last = from_range + 1, to_range - kmer_length - max_gap + 1
    groups = []
    for g in range(min_gap, max_gap + 1):
        if g == 0:
            groups.append(_windows(seq, kmer_length, first, last))
            continue
        wide = _windows(seq, kmer_length + g, first, last)
        for k1 in range(2, kmer_length - 1):
            groups.append(_gapped(wide, k1, g, kmer_length - k1))
    return F.concat(*groups) if len(groups) > 1 else groups[0]


#: Bases whose patterns are counted at once; patterns that a task's table holds, or as many sums in the order met.
SLICE, HELD = 1 << 15, 1 << 20
#: Codes of letters: A, C, G, T, then N; others have none.
_LETTER = np.full(128, 9, np.uint8)
_LETTER[[ord(c) for c in "ACGTN"]] = range(5)


def _pattern_sums(k: int, min_gap: int, max_gap: int, first: int, to_range: int | None, responses: int):
    """A kernel from (seq, y) to partial sums of each pattern: of n, n * n, then n * y and n where y is known, for each y.

    n is a row's count of the pattern, at most ``MOST_COUNTED``; the patterns are those
    of ``screen_patterns`` without N. A task adds up the sums of its rows, so a pattern
    leaves it about once. Patterns of A, C, G and T are numbers, others strings.
    """
    forms = [(g, k1) for g in range(min_gap, max_gap + 1) for k1 in (range(2, k - 1) if g else (k,))]
    space = len(forms) * 4**k
    columns = 2 + 2 * responses

    def starts(width: int) -> int:
        return min(width, width if to_range is None else to_range) - k - max_gap + 1 - first

    def places(g: int, k1: int) -> list[int]:
        return [j if j < k1 else j + g for j in range(k)]

    def weighted(n: np.ndarray, y: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
        return [n, n * n, *(v for i in range(responses) for v in (n * y[:, i], n * known[:, i]))]

    def counted(codes: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(patterns, in order, and their sums) of sequences of one length."""
        n, many = len(codes), starts(codes.shape[1])
        cells = []
        for f, (g, k1) in enumerate(forms if many > 0 else []):
            word, bad = np.full((n, many), f, np.int64), np.zeros((n, many), bool)
            for j in places(g, k1):
                c = codes[:, first + j : first + j + many]
                word <<= 2
                word |= c & 3
                bad |= c > 3
            word *= n
            word += np.arange(n)[:, None]
            cells.append(word[~bad])
        cells, n_of = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_counts=True)
        word, row = np.divmod(cells, n)
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        c = np.minimum(n_of, MOST_COUNTED).astype(float)
        sums = [np.add.reduceat(v, begin) if len(begin) else v for v in weighted(c, y[row], known[row])]
        return word[begin], np.stack(sums, axis=1)

    def spelt(texts: list[str], y: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        """The same for any letters and lengths."""
        out: dict[str, np.ndarray] = {}
        for i, t in enumerate(texts):
            n_of = Counter(t[s : s + k1] + "*" * g + t[s + k1 + g : s + k + g] for g, k1 in forms for s in range(first, first + max(0, starts(len(t)))))
            for p, n in n_of.items():
                if "N" not in p:
                    own = np.array(weighted(np.array([float(min(n, MOST_COUNTED))]), y[i : i + 1], known[i : i + 1]))[:, 0]
                    out[p] = out[p] + own if p in out else own
        return out

    def names(words: np.ndarray) -> list[str]:
        letters = np.empty((len(words), k), np.uint32)
        for j in range(k):
            letters[:, j] = np.frombuffer(b"ACGT", np.uint8)[words >> 2 * (k - 1 - j) & 3]
        out = np.empty(len(words), object)
        for f, (g, k1) in enumerate(forms):
            at = words >> 2 * k == f
            full = np.full((int(at.sum()), k + g), ord("*"), np.uint32)
            full[:, places(g, k1)] = letters[at]
            out[at] = full.view(f"U{k + g}").ravel().tolist()
        return out.tolist()

    def batch_of(kmers: list[str], sums: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kmers) + 1, dtype=np.int32) * columns), pa.array(np.ascontiguousarray(sums, float).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(kmers, pa.string()), lists], names=["kmer", "sums"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((space, columns)) if space <= HELD else None
        for batch in batches:
            flat = batch.column("y").flatten()
            known = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(batch.num_rows, responses)
            y = np.where(known, flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, responses), 0.0)
            texts = np.array(batch.column("seq").to_pylist(), object)
            lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                step = max(1, SLICE // max(1, int(length)))
                for s in range(0, len(at), step):
                    part = at[s : s + step]
                    own = texts[part].tolist()
                    text = "".join(own)
                    codes = _LETTER[np.frombuffer(text.encode(), np.uint8)].reshape(len(part), length) if text.isascii() else None
                    if codes is None or (codes > 4).any() or space * len(part) >= 2**62:
                        found = spelt(own, y[part], known[part])
                        if found:
                            yield batch_of(list(found), np.array(list(found.values())))
                        continue
                    words, sums = counted(codes, y[part], known[part])
                    if table is not None:
                        table[words] += sums
                    elif len(words):
                        yield batch_of(names(words), sums)
        if table is not None:
            words = np.flatnonzero(table[:, 0])
            for s in range(0, len(words), 1 << 16):
                yield batch_of(names(words[s : s + (1 << 16)]), table[words[s : s + (1 << 16)]])

    return work


def screen_kmers(df: DataFrame, responses: list[str], kmer_length: int = 6, min_cor: float = 0.08, min_gap: int = 0, max_gap: int = 0, from_range: int = 0, to_range: int | None = None, train_col: str | None = None) -> DataFrame:
    """kmer, max_r2, avg_n, avg_var and the correlation with each response, best first.

    A sequence that lacks a k-mer counts as zero without being materialised; counts
    are capped at 19; patterns with N are skipped.
    """
    if not 0 <= min_gap <= max_gap:
        raise ValueError("0 <= min_gap <= max_gap is required")
    df = require_sequences(df)
    if train_col:
        df = df.where(F.col(train_col))
    y = [F.col(r).cast("double") for r in responses]
    total = df.agg(F.count(F.lit(1)).cast("double").alias("n_all"), *(F.avg(c).alias(f"ey_{i}") for i, c in enumerate(y)), *(F.avg(c * c).alias(f"ey2_{i}") for i, c in enumerate(y)))
    rows = df.select(F.upper("seq").alias("seq"), F.array(*y).alias("y"))
    sums = rows.mapInArrow(_pattern_sums(kmer_length, min_gap, max_gap, from_range, to_range, len(y)), "kmer string, sums array<double>")
    of = lambda i: F.sum(F.col("sums")[i])
    sums = sums.groupBy("kmer").agg(of(0).alias("sn"), of(1).alias("sn2"), *(F.when(of(3 + 2 * i) > 0, of(2 + 2 * i)).alias(f"sny_{i}") for i in range(len(y))))
    # ``total`` is one row.
    stats = sums.crossJoin(F.broadcast(total)).withColumn("avg_n", F.col("sn") / F.col("n_all")).withColumn("avg_var", F.col("sn2") / F.col("n_all") - F.col("avg_n") * F.col("avg_n"))
    for i, name in enumerate(responses):
        var = F.col("avg_var") * (F.col(f"ey2_{i}") - F.col(f"ey_{i}") * F.col(f"ey_{i}"))
        cov = F.col(f"sny_{i}") / F.col("n_all") - F.col("avg_n") * F.col(f"ey_{i}")
        stats = stats.withColumn(f"__r_{i}", F.when(var > 1e-300, cov / F.sqrt(var)))
    r = [F.coalesce(F.col(f"__r_{i}") * F.col(f"__r_{i}"), F.lit(0.0)) for i in range(len(responses))]
    best = F.greatest(*r) if len(r) > 1 else r[0]
    out = stats.select("kmer", best.alias("max_r2"), "avg_n", "avg_var", *(F.col(f"__r_{i}").alias(name) for i, name in enumerate(responses)))
    return out.where(F.col("max_r2") > min_cor * min_cor).orderBy(F.desc("max_r2"), "kmer")


def osa_distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no substring edited twice."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return int(d[-1, -1])


def candidate_kmers(df: DataFrame, responses: list[str], kmer_lengths: list[int], min_gap: int = 0, max_gap: int = 1, min_kmer_cor: float = 0.08, max_cands: int = 10) -> list[str]:
    """Seeds for a regression, best first.

    Screens every length, halves the threshold once if nothing is found, keeps the
    ``max_cands`` best and of each community of k-mers at distance 1 the best.
    """

    def screened(cor: float) -> list:
        found = None
        for k in kmer_lengths:
            one = screen_kmers(df, responses, k, cor, min_gap=min_gap, max_gap=max_gap).select("kmer", "max_r2")
            found = one if found is None else found.unionByName(one)
        return found.groupBy("kmer").agg(F.max("max_r2").alias("max_r2")).orderBy(F.desc("max_r2"), "kmer").limit(max_cands).collect()

    top = screened(min_kmer_cor) or screened(min_kmer_cor / 2)
    if not top:
        return ["*" * kmer_lengths[0]]
    names = [r.kmer for r in top]
    group = communities(len(names), [(j, i) for i in range(len(names)) for j in range(i) if osa_distance(names[i], names[j]) == 1])
    return [names[i] for i in range(len(names)) if group.index(group[i]) == i]


def communities(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """The community of each of a few nodes by Louvain's method: a community is named by its first node.

    Nodes move, in their order, to the neighbouring community of the largest gain in
    modularity (ties: the first) until none gains; communities become nodes, and so
    on. No random numbers: the same graph gives the same communities.
    """
    weight: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for i, j in edges:
        weight[i][j] = weight[i].get(j, 0) + 1
        weight[j][i] = weight[j].get(i, 0) + 1
    member, total = list(range(n)), 2 * len(edges)
    while total:
        own = {i: i for i in weight}
        degree = {i: sum(w.values()) for i, w in weight.items()}
        held = dict(degree)
        again, moves = True, 0
        while again:
            again = False
            for i in sorted(weight):
                near: dict[int, float] = {own[i]: 0.0}
                for j, w in weight[i].items():
                    if j != i:
                        near[own[j]] = near.get(own[j], 0.0) + w
                held[own[i]] -= degree[i]
                gain = {c: w - held[c] * degree[i] / total for c, w in near.items()}
                best = min(gain, key=lambda c: (-gain[c], c != own[i], c))
                if gain[best] <= gain[own[i]] + 1e-12:
                    best = own[i]
                moves += best != own[i]
                again |= best != own[i]
                own[i] = best
                held[best] += degree[i]
        first = {c: min(i for i in own if own[i] == c) for c in set(own.values())}
        member = [first[own[m]] for m in member]
        if not moves:
            break
        merged: dict[int, dict[int, float]] = {c: {} for c in first.values()}
        for i, ws in weight.items():
            for j, w in ws.items():
                a, b = first[own[i]], first[own[j]]
                merged[a][b] = merged[a].get(b, 0) + w
        weight = merged
    return [member.index(m) for m in member]


def dinucleotides(df: DataFrame) -> DataFrame:
    """seq_id and the counts of the 16 overlapping pairs; an empty sequence is an error."""
    seq = F.when(F.length("seq") == 0, F.raise_error(F.lit("empty sequence"))).otherwise(F.upper("seq"))
    return df.select("seq_id", *(F.regexp_count(seq, F.lit(f"{w[0]}(?={w[1]})")).cast("bigint").alias("".join(w)) for w in product("ACGT", repeat=2)))


def nucleotide_distribution(df: DataFrame, n: int = 2, size: int | None = None) -> DataFrame:
    """pos and, for each of the 4^n n-mers, the share of sequences that have it there.

    ``size``: positions, by default the length of the longest sequence. The last
    n - 1 positions are null; a shorter sequence is an error.
    """
    words = ["".join(p) for p in product("ACGT", repeat=n)]
    length = F.length("seq")
    shortest, longest = df.agg(F.min(length), F.max(length)).first()
    if size is None:
        size = longest or 0
    if shortest is not None and shortest < size:
        raise ValueError("a sequence is shorter than the size")
    spine = df.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("pos"))
    starts = size - n + 1
    if starts < 1:
        return spine.select("pos", *(F.lit(None).cast("double").alias(w) for w in words)).orderBy("pos")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((starts, 4**n), np.int64), 0
        for batch in batches:
            texts = [t for t in batch.column("seq").to_pylist() if t is not None]
            rows += len(texts)
            step = max(1, SLICE // size)
            for s in range(0, len(texts), step):
                part = texts[s : s + step]
                codes = _LETTER[np.minimum(np.frombuffer("".join(t[:size] for t in part).encode("latin-1", "replace"), np.uint8), 127)].reshape(len(part), size)
                word, bad = np.zeros((len(part), starts), np.int64), np.zeros((len(part), starts), bool)
                for j in range(n):
                    c = codes[:, j : j + starts]
                    word <<= 2
                    word |= c & 3
                    bad |= c > 3
                word += np.arange(starts) * 4**n
                held += np.bincount(word[~bad], minlength=held.size).reshape(held.shape)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, starts + 1), pa.int32()), pa.array(np.full(starts, rows)), *(pa.array(np.ascontiguousarray(c)) for c in held.T)], names=["pos", "rows", *words])

    # A row of counts for each position leaves a task.
    at = df.select(F.upper("seq").alias("seq")).mapInArrow(count, ", ".join(["pos int", "rows bigint", *(f"{w} bigint" for w in words)]))
    shares = at.groupBy("pos").agg(*((F.sum(w) / F.sum("rows")).alias(w) for w in words))
    return spine.join(F.broadcast(shares), "pos", "left").select("pos", *words).orderBy("pos")
