"""Algebra of position weight matrices on tidy tables (motif, pos, A, C, G, T).

Every function works on all motifs of the table at once. ``pos`` may start at 0 or
1; order is by ``pos``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = ["A", "C", "G", "T"]


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def validate(df: DataFrame) -> DataFrame:
    missing = [c for c in LETTERS if c not in df.columns]
    if missing:
        raise ValueError(f"the matrix should have columns A, C, G, T; missing: {', '.join(missing)}")
    return df


def with_prior(df: DataFrame, prior: float = 0.01, normalise_first: bool = False) -> DataFrame:
    """Adds the prior and divides rows by their sum."""
    if not 0 <= prior <= 1:
        raise ValueError("prior should be between 0 and 1")
    validate(df)
    raw = [F.col(c).cast("double") for c in LETTERS]
    p = [c / _sum(raw) for c in raw] if normalise_first else raw
    p = [c + F.lit(float(prior)) for c in p]
    return df.withColumns({c: x / _sum(p) for c, x in zip(LETTERS, p)})


def bits_per_pos(df: DataFrame, prior: float = 0.01) -> DataFrame:
    """motif, pos, bits: 2 + sum of p log2 p, 0 at least."""
    p = with_prior(df, prior)
    entropy = _sum([F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c))).otherwise(F.lit(0.0)) for c in LETTERS])
    return p.select("motif", "pos", F.greatest(F.lit(2.0) + entropy, F.lit(0.0)).alias("bits"))


def theoretical_range(df: DataFrame, prior: float = 0.01, regularization: float = 0.01) -> DataFrame:
    """motif, min_score, max_score of one window."""
    p = with_prior(df, prior)
    cols = [F.col(c) for c in LETTERS]
    return p.groupBy("motif").agg(F.sum(F.ln(F.lit(regularization) + F.least(*cols))).alias("min_score"), F.sum(F.ln(F.lit(regularization) + F.greatest(*cols))).alias("max_score"))


def quantile(df: DataFrame, q: float, prior: float = 0.01, regularization: float = 0.01) -> DataFrame:
    r = theoretical_range(df, prior, regularization)
    return r.select("motif", (F.col("min_score") + F.lit(float(q)) * (F.col("max_score") - F.col("min_score"))).alias("score"))


#: Ambiguity letters of two bases (fixed values).
PAIRS = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def consensus(df: DataFrame, single_thresh: float = 0.4, double_thresh: float = 0.6) -> DataFrame:
    """motif, consensus: base, ambiguity letter or * per position, outer stars removed, null if none is left.

    Probabilities are taken in thousandths after a cast to float, ties go to the later base.
    """
    validate(df)
    raw = [F.col(c).cast("float") for c in LETTERS]
    total = _sum(raw)
    ranks = F.array_sort(F.array(*(F.struct((F.floor(((c / total).cast("float") * F.lit(1000.0).cast("float")).cast("float")) * 4 + i).cast("int").alias("k"), F.lit(l).alias("l")) for i, (c, l) in enumerate(zip(raw, LETTERS)))))
    rows = df.select("motif", "pos", ranks.alias("r"))
    top, second = F.col("r")[3], F.col("r")[2]
    pair = F.concat(F.least(top["l"], second["l"]), F.greatest(top["l"], second["l"]))
    ambiguous = F.create_map(*(F.lit(x) for kv in PAIRS.items() for x in kv))[pair]
    letter = F.when(top["k"] > F.lit(single_thresh * 4000), top["l"]).when(top["k"] + second["k"] >= F.lit(4000 * double_thresh), ambiguous).otherwise(F.lit("*"))
    joined = rows.select("motif", "pos", letter.alias("c")).groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("s"))
    return joined.select("motif", F.nullif(F.regexp_replace("s", r"^\*+|\*+$", ""), F.lit("")).alias("consensus"))


def reverse_complement(df: DataFrame) -> DataFrame:
    """Swaps A with T and C with G and turns the rows around, keeping the position labels."""
    validate(df)
    w = Window.partitionBy("motif").orderBy("pos")
    back = Window.partitionBy("motif").orderBy(F.desc("pos"))
    n = df.withColumn("__i", F.row_number().over(w)).withColumn("__j", F.row_number().over(back))
    labels = n.select("motif", F.col("pos").alias("__pos"), F.col("__i").alias("__k"))
    turned = n.select("motif", F.col("__j").alias("__k"), F.col("T").alias("A"), F.col("G").alias("C"), F.col("C").alias("G"), F.col("A").alias("T"))
    return turned.join(labels, ["motif", "__k"]).select("motif", F.col("__pos").alias("pos"), *LETTERS)


def trim(df: DataFrame, bits_thresh: float = 0.1, prior: float = 0.01) -> DataFrame:
    """Cuts low-information ends; positions start at 0 again. A motif without any informative position disappears."""
    bits = bits_per_pos(df, prior)
    ends = bits.where(F.col("bits") > bits_thresh).groupBy("motif").agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    kept = df.join(ends, "motif").where(F.col("pos").between(F.col("__lo"), F.col("__hi")))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("motif").orderBy("pos")) - 1).select("motif", "pos", *LETTERS)


def concat(first: DataFrame, second: DataFrame, gap: int = 0, trim_ends: bool = True, bits_thresh: float = 0.1, orientation: str = "ff") -> DataFrame:
    """Joins the motifs of both tables that share a name, with ``gap`` uniform rows between."""
    if orientation not in ("ff", "fr", "rf", "rr"):
        raise ValueError("orientation must be one of ff, fr, rf, rr")
    parts = []
    for side, (df, o) in enumerate(zip((first, second), orientation)):
        df = trim(df, bits_thresh) if trim_ends else df
        df = reverse_complement(df) if o == "r" else df
        parts.append(df.select("motif", F.lit(2 * side).alias("__part"), "pos", *(F.col(c).cast("double").alias(c) for c in LETTERS)))
    both = parts[0].select("motif").distinct().join(parts[1].select("motif").distinct(), "motif", "left_semi")
    if gap > 0:
        filler = both.select("motif", F.lit(1).alias("__part"), F.explode(F.sequence(F.lit(0), F.lit(gap - 1))).alias("pos"), *(F.lit(0.25).alias(c) for c in LETTERS))
        parts.insert(1, filler)
    joined = reduce(lambda a, b: a.unionByName(b), parts).join(both, "motif", "left_semi")
    return joined.select("motif", (F.row_number().over(Window.partitionBy("motif").orderBy("__part", "pos")) - 1).alias("pos"), *LETTERS)


def kmers_to_pssm(kmers: DataFrame, prior: float = 0.01) -> DataFrame:
    """(kmer, pos from 1, A, C, G, T): 1 at the base, the prior elsewhere, rows divided by their sum; N is uniform."""
    if not 0 <= prior <= 1:
        raise ValueError("prior should be between 0 and 1")
    bad = F.raise_error(F.concat(F.lit("a k-mer may hold A, C, G, T and N only: "), F.col("kmer")))
    checked = kmers.select(F.when(F.col("kmer").rlike("^[ACGTN]*$"), F.col("kmer")).otherwise(bad).alias("kmer"))
    rows = checked.select("kmer", F.posexplode(F.filter(F.split("kmer", ""), lambda c: c != "")).alias("i", "b"))
    one = lambda c: F.when(F.col("b") == "N", F.lit(0.25)).otherwise(F.when(F.col("b") == c, F.lit(1.0)).otherwise(F.lit(float(prior))) / F.lit(1 + 3 * float(prior)))
    return rows.select("kmer", (F.col("i") + 1).alias("pos"), *(one(c).alias(c) for c in LETTERS))


def pssm_to_kmer(df: DataFrame, kmer_length: int | None = None, pos_bits_thresh: float | None = None, prior: float = 0.01) -> DataFrame:
    """motif, kmer: the most informative window of ``kmer_length`` rows (the first of equals), as its likeliest bases."""
    bits = bits_per_pos(df, prior)
    rows = df.join(bits, ["motif", "pos"])
    w = Window.partitionBy("motif").orderBy("pos")
    n = F.count(F.lit(1)).over(Window.partitionBy("motif"))
    rows = rows.withColumn("__i", F.row_number().over(w)).withColumn("__n", n)
    k = F.lit(kmer_length) if kmer_length else F.col("__n")
    after = w.rowsBetween(0, kmer_length - 1) if kmer_length else w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("__sum", F.sum("bits").over(after)).withColumn("__k", k)
    best = rows.where(F.col("__i") + F.col("__k") - 1 <= F.col("__n")).groupBy("motif").agg(F.max(F.struct(F.round("__sum", 9).alias("s"), (-F.col("__i")).alias("m"))).alias("__best"))
    chosen = rows.join(best, "motif").where((F.col("__i") >= -F.col("__best.m")) & (F.col("__i") < -F.col("__best.m") + F.col("__k")))
    top = F.greatest(*LETTERS)
    base = F.when(F.col("A") == top, "A").when(F.col("C") == top, "C").when(F.col("G") == top, "G").otherwise("T")
    if pos_bits_thresh is not None:
        base = F.when(F.col("bits") > pos_bits_thresh, base).otherwise("N")
    return chosen.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", base.alias("b")))), lambda x: x["b"]), "").alias("kmer"))


def letter_heights(df: DataFrame, prior: float = 0.01, method: str = "bits") -> DataFrame:
    """Heights of a sequence logo: motif, pos, letter, height (probability times bits, or the probability)."""
    p = with_prior(df, prior).select("motif", "pos", *LETTERS).join(bits_per_pos(df, prior), ["motif", "pos"])
    long = p.unpivot(["motif", "pos", "bits"], LETTERS, "letter", "p")
    return long.select("motif", "pos", "letter", (F.col("p") * F.col("bits") if method == "bits" else F.col("p")).alias("height"))


def to_matrix(df: DataFrame) -> dict[str, list[list[float]]]:
    """Motif name to rows of A, C, G, T in the order of ``pos`` (a bounded motif table, collected)."""
    out: dict[str, list[list[float]]] = {}
    for r in sorted(validate(df).select("motif", "pos", *LETTERS).collect(), key=lambda r: (r.motif, r.pos)):
        out.setdefault(r.motif, []).append([r[c] for c in LETTERS])
    return out


def from_matrix(spark, matrices: dict[str, list[list[float]]]) -> DataFrame:
    """The tidy table of such rows, positions from 1."""
    rows = [(name, i, *map(float, row)) for name, matrix in matrices.items() for i, row in enumerate(matrix, 1)]
    return spark.createDataFrame(rows, "motif string, pos int, A double, C double, G double, T double")


def validate_spatial(bins: list[int], factors: list[float]) -> int:
    """The bin size of a spatial model; equal-width bins and non-negative factors are required."""
    if len(bins) != len(factors) or len(bins) < 2:
        raise ValueError("a spatial model needs as many bins as factors, two at least")
    sizes = {b - a for a, b in zip(bins, bins[1:])}
    if len(sizes) > 1 or min(sizes) <= 0:
        raise ValueError("the bins of a spatial model must have one size")
    if any(f < 0 for f in factors):
        raise ValueError("spatial factors must not be negative")
    return sizes.pop()
