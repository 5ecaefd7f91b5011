"""Genome intervals: sequences, scores, quantiles against a background.

A genome is a table (chrom, seq), or ``Genome`` tiles of it, which is what the
operators work on: an interval meets the tiles it touches, so no row and no key
ever holds a chromosome. Starts count from 0, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.operators.ranks import draw
from strandlab.operators.scoring import Motif, Spatial, best_position, compute_local_pwm, extract_pwm
from strandlab.operators.stats import quantiles
from strandlab.sources.fasta import read_fasta

COORDS = ["chrom", "start", "end"]
TILE = 2**16


@dataclass(frozen=True)
class Genome:
    """Tiles (chrom, at, seq): the bases from ``at``, a multiple of ``size``; ``size`` of them but for the last tile."""

    tiles: DataFrame
    size: int

    @classmethod
    def of(cls, genome: DataFrame | Genome, size: int = TILE) -> Genome:
        if isinstance(genome, Genome):
            return genome
        pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        rows = genome.select("chrom", F.posexplode(pieces).alias("n", "seq"))
        return cls(rows.select("chrom", (F.col("n") * F.lit(size).cast("bigint")).alias("at"), "seq"), size)

    @classmethod
    def fasta(cls, spark: SparkSession, path: str, size: int = TILE) -> Genome:
        """A FASTA file, a folder or a glob of them, read by byte ranges (``sources.fasta``)."""
        return cls(read_fasta(spark, path, size), size)

    def lengths(self) -> DataFrame:
        return self.tiles.groupBy("chrom").agg(F.sum(F.length("seq")).alias("length"))


def normalise(intervals: DataFrame, size: int) -> DataFrame:
    """Same centre (rounded down), given size."""
    centre = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    return intervals.withColumn("__c", centre).withColumn("start", F.col("__c") - size // 2).withColumn("end", F.col("__c") - size // 2 + size).drop("__c")


def intervals_to_seq(intervals: DataFrame, genome: DataFrame | Genome, size: int | None = None) -> DataFrame:
    """``intervals`` with their upper-case sequences; what lies outside a chromosome is cut off, intervals on no known chromosome are dropped.

    Joined by (chromosome, tile); an interval over several tiles is put together from its pieces.
    """
    genome = Genome.of(genome)
    wanted = normalise(intervals, size) if size else intervals
    tile = F.lit(genome.size).cast("bigint")
    first = F.greatest(F.col("start"), F.lit(0)).cast("bigint")
    spans = wanted.select("chrom", first.alias("from"), F.col("end").cast("bigint").alias("to")).distinct()
    ats = F.when(F.col("to") > F.col("from"), F.sequence(F.floor(F.col("from") / tile) * tile, F.floor((F.col("to") - 1) / tile) * tile, tile))
    touched = spans.withColumn("at", F.explode(ats)).join(genome.tiles, ["chrom", "at"])
    begin, end = F.greatest(F.col("from"), F.col("at")), F.least(F.col("to"), F.col("at") + tile)
    piece = F.substr("seq", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int"))
    pieces = touched.groupBy("chrom", "from", "to").agg(F.sort_array(F.collect_list(F.struct("at", piece.alias("s")))).alias("p"))
    found = pieces.select(F.col("chrom").alias("__c"), "from", "to", F.upper(F.array_join(F.transform("p", lambda x: x["s"]), "")).alias("seq"))
    known = wanted.join(genome.tiles.select("chrom").distinct(), "chrom", "left_semi")
    here = (F.col("chrom") == F.col("__c")) & (first == F.col("from")) & (F.col("end") == F.col("to"))
    return known.join(found, here, "left").drop("__c", "from", "to").withColumn("seq", F.coalesce("seq", F.lit("")))


def extract_interval_pwm(intervals: DataFrame, genome: DataFrame | Genome, motifs: list[Motif], **options) -> DataFrame:
    """Long scores: chrom, start, end, motif, pwm."""
    return extract_pwm(intervals_to_seq(intervals, genome), motifs, id_cols=COORDS, **options)


def interval_local_pwm(intervals: DataFrame, genome: DataFrame | Genome, motif: Motif, **options) -> DataFrame:
    """Local energies of each interval, with a name chrom_start_end."""
    scored = compute_local_pwm(intervals_to_seq(intervals, genome), motif, **options)
    return scored.select(F.concat_ws("_", *COORDS).alias("name"), *COORDS, "local")


def centre_by_pssm(intervals: DataFrame, genome: DataFrame | Genome, motif: Motif, **options) -> DataFrame:
    """Moves each interval to its best window (start plus the position from 1), at its own size."""
    found = best_position(intervals_to_seq(intervals, genome), motif, **options)
    width = F.col("end") - F.col("start")
    centre = F.col("start") + F.col("best")
    moved = found.withColumn("__s", (centre - F.floor(width / 2)).cast("int")).withColumn("__e", (F.col("__s") + width).cast("int"))
    return moved.select("chrom", F.col("__s").alias("start"), F.col("__e").alias("end"))


def random_intervals(genome: DataFrame | Genome, size: int | DataFrame, n: int = 10_000, dist_from_edge: int = 0, seed: int = 60427) -> DataFrame:
    """``n`` intervals spread over the chromosomes by length, from seeded hashes (reproducible anywhere).

    ``size`` may be a table of sizes (column ``size``): then n of each.
    """
    genome = Genome.of(genome)
    spark = genome.tiles.sparkSession
    sizes = size if isinstance(size, DataFrame) else spark.range(1).select(F.lit(size).alias("size"))
    room = genome.lengths().crossJoin(sizes).select("chrom", "size", (F.col("length") - F.col("size") - 2 * dist_from_edge).alias("room")).where("room > 0")
    along = Window.partitionBy("size").orderBy("chrom").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per chromosome
    spread = room.select("chrom", "size", "room", F.sum("room").over(along).alias("upto"), F.sum("room").over(Window.partitionBy("size")).alias("total"))
    u = F.conv(F.substring(draw("id", seed), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
    draws = spark.range(n).select(u.alias("u")).crossJoin(sizes)
    hits = draws.join(spread, "size").withColumn("at", F.floor(F.col("u") * F.col("total")) - (F.col("upto") - F.col("room")))
    hits = hits.where((F.col("at") >= 0) & (F.col("at") < F.col("room")))
    start = (F.col("at") + dist_from_edge).cast("int")
    return hits.select("chrom", start.alias("start"), (start + F.col("size")).cast("int").alias("end"))


def pwm_quantiles(size: int, probs: list[float], motifs: list[Motif], genome: DataFrame | Genome, background: DataFrame | None = None, n: int = 10_000, **options) -> DataFrame:
    """motif, quantiles: exact quantiles of the energy on background intervals of one size."""
    bg = background if background is not None else random_intervals(genome, size, n)
    return quantiles(extract_interval_pwm(bg, genome, motifs, **options), "pwm", probs, ["motif"])


def to_quantile(scores: DataFrame, breaks: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    """``scores`` with q: linear interpolation of pwm between the breakpoints, clamped at the ends, joined by ``keys``."""
    q = F.array(*(F.lit(float(p)) for p in probs))
    v = F.col("quantiles")
    k = F.size(F.filter(v, lambda x: x <= F.col("pwm")))  # breakpoints not above
    lo, hi = F.get(v, k - 1), F.get(v, k)
    inside = F.get(q, k - 1) + (F.get(q, k) - F.get(q, k - 1)) * F.try_divide(F.col("pwm") - lo, hi - lo)
    value = F.when(k == 0, F.get(q, F.lit(0))).when(k >= F.size(v), F.get(q, F.size(v) - 1)).otherwise(inside)
    return scores.join(breaks, keys).withColumn("q", F.when(F.col("pwm").isNotNull(), value)).drop("quantiles")


def interval_pwm_quantiles(intervals: DataFrame, genome: DataFrame | Genome, motifs: list[Motif], precision: float = 0.01, n: int = 10_000, **options) -> DataFrame:
    """chrom, start, end, motif, pwm, q: the quantile of each score among random intervals of the same length.

    Breakpoints of all occurring lengths come from one job and are joined by key, so mixed lengths keep their rows.
    """
    genome = Genome.of(genome)
    width = F.col("end") - F.col("start")
    scores = extract_interval_pwm(intervals, genome, motifs, **options).withColumn("size", width)
    probs = [i * precision for i in range(int(round(1 / precision)) + 1)]
    background = random_intervals(genome, intervals.select(width.alias("size")).distinct(), n)
    drawn = extract_interval_pwm(background, genome, motifs, **options).withColumn("size", width)
    return to_quantile(scores, quantiles(drawn, "pwm", probs, ["motif", "size"]), probs, ["motif", "size"]).drop("size")


def local_pwm_frequency(intervals: DataFrame, genome: DataFrame | Genome, motif: Motif, q_threshold: float, background: DataFrame | None = None, n: int = 10_000, **options) -> DataFrame:
    """chrom, start, end, hits: 0/1 per position, whether the local energy exceeds the background's quantile by 1e-9."""
    if background is None:
        size = intervals.select((F.col("end") - F.col("start")).alias("n")).first()[0]
        background = random_intervals(genome, size, n)
    bg = compute_local_pwm(intervals_to_seq(background, genome), motif, **options).select(F.explode("local").alias("v"))
    limit = F.broadcast(bg.agg(F.percentile("v", F.lit(float(q_threshold))).alias("__limit")))
    scored = compute_local_pwm(intervals_to_seq(intervals, genome), motif, **options).crossJoin(limit)
    return scored.select(*COORDS, F.transform("local", lambda x: (x > F.col("__limit") + 1e-9).cast("int")).alias("hits"))
