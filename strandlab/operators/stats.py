"""Statistics used as aggregates: r squared, Kolmogorov-Smirnov, quantiles, least squares."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators.ranks import running
from strandlab.operators.session import checkpointed


def r_squared(x: Column, y: Column) -> Column:
    """Squared Pearson correlation as an aggregate; null where either side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.pow(F.covar_pop(x, y), 2) / (F.var_pop(x) * F.var_pop(y)))


ALTERNATIVES = {"two.sided", "less", "greater"}


#: Width of the cells of value (energies: natural logarithms) that are summed before a group's running sums.
CELL = 1 / 256


def cells(value: str, width: float = CELL) -> Column:
    return F.floor(F.col(value) / F.lit(width))


def ks_distance(df: DataFrame, value: str, label: str, by: list[str], alternative: str = "two.sided", cell: float = CELL) -> DataFrame:
    """Two-sample KS distance of ``value`` between label 1 and label 0, per group.

    Ties are merged, then summed by cells of ``cell`` units of the value: no window
    holds a group, whatever its size. greater: the distribution of label 1 lies
    above (its values are smaller); less: below.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError("alternative must be two.sided, less or greater")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("c1"), F.sum((F.col(label) == 0).cast("bigint")).alias("c0"))
    counts = checkpointed(counts)  # read twice; what gives the values is computed once
    steps = running(counts, by, value, cells(value, cell), {"c1": ("r1", "n1"), "c0": ("r0", "n0")})
    gap = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("r1") / F.nullif("n1", F.lit(0)) - F.col("r0") / F.nullif("n0", F.lit(0)))
    signed = {"two.sided": F.abs(gap), "greater": gap, "less": -gap}[alternative]
    return steps.groupBy(*by).agg(F.max(signed).alias("D"), F.max("n1").alias("n1"), F.max("n0").alias("n0"))


def percent_ranks(df: DataFrame, value: str, by: list[str], out_col: str = "q", cell: float = CELL) -> DataFrame:
    """``df`` (without null values) with the share of its group's other rows that are smaller: rank - 1 over rows - 1."""
    df = checkpointed(df)  # read three times; what gives the values is computed once
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    steps = running(counts, by, value, cells(value, cell), {"__c": ("__up", "__n")})
    share = F.when(F.col("__n") > 1, (F.col("__up") - F.col("__c")) / F.nullif(F.col("__n") - 1, F.lit(0))).otherwise(F.lit(0.0))
    return df.join(steps.select(*by, value, share.alias(out_col)), [*by, value])


#: Below this product of the two numbers of rows a p-value is exact.
EXACT = 10_000


def ks_p_value(d: float, n1: int, n0: int, alternative: str = "two.sided", ties: list[int] | None = None) -> float:
    """P-value of a distance: exact where n1 * n0 is below ``EXACT``, else asymptotic.

    ``ties``: how many rows hold each value, in the order of the values (None: all differ); it counts where the value is exact.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError("alternative must be two.sided, less or greater")
    if n1 * n0 < EXACT:
        return _exact_ks(d, n1, n0, alternative, ties)
    z = d * math.sqrt(n1 * n0 / (n1 + n0))
    if alternative != "two.sided":
        return math.exp(-2 * z * z)
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))


def _exact_ks(d: float, n1: int, n0: int, alternative: str, ties: list[int] | None) -> float:
    """Share of the orders of n1 and n0 rows that reach the distance.

    An order is a path on the lattice of (rows of one sample, rows of the other) so
    far; paths below the distance are counted in whole numbers. The distribution
    functions meet only where a value ends, so only there is a path held against it.
    """
    least = math.ceil(d * n1 * n0 - 1e-7)  # the distance times n1 * n0
    ends = set(range(n1 + n0 + 1) if ties is None else accumulate(ties))
    reached = {"two.sided": lambda gap: abs(gap) >= least, "greater": lambda gap: gap >= least, "less": lambda gap: -gap >= least}[alternative]
    below = [0] * (n0 + 1)
    for i in range(n1 + 1):
        for j in range(n0 + 1):
            paths = 1 if i == j == 0 else (below[j] if i else 0) + (below[j - 1] if j else 0)
            below[j] = 0 if i + j in ends and reached(i * n0 - j * n1) else paths
    total = math.comb(n1 + n0, n1)
    return (total - below[n0]) / total


#: Bins of one narrowing histogram; rows that are ordered together at most.
BINS, ORDERED = 1024, 65_536


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str], bins: int = BINS, ordered: int = ORDERED) -> DataFrame:
    """Exact linear-interpolation quantiles (type 7) per group as an array; null for a group without values.

    The values at the ranks around each quantile are selected by histograms that
    narrow: a pass counts the rows between the bounds of every rank still open in
    ``bins`` bins, a window over those bins finds the bin that holds the rank, and its
    smallest and largest value are the next bounds, until these are equal or hold
    ``ordered`` rows at most, which are then ordered. No task holds a group's values.
    """
    probs = [float(p) for p in probs]
    keys = [f"__by{i}" for i in range(len(by) or 1)]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), *([] if by else [F.lit(0).alias(keys[0])]), F.col(value).cast("double").alias("v")).persist()

    def same(names: list[str], tail: str) -> list[Column]:
        return [F.col(c).eqNullSafe(F.col(c + tail)) for c in names]

    def inside(wanted: DataFrame) -> DataFrame:
        """(keys, lo, hi, v): the rows within the bounds of each range."""
        ranges = wanted.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
        met = rows.join(ranges.withColumnsRenamed({k: f"{k}_r" for k in keys}), same(keys, "_r"))
        return met.select(*keys, "v", F.explode(F.filter("ranges", lambda r: (F.col("v") >= r.lo) & (F.col("v") <= r.hi))).alias("r")).select(*keys, "r.lo", "r.hi", "v")

    try:
        ends = checkpointed(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        at = F.array(*((F.col("n") - 1) * F.lit(p) for p in probs))
        ranks = F.array_distinct(F.flatten(F.array(F.transform(at, lambda h: F.floor(h)), F.transform(at, lambda h: F.ceil(h)))))
        # One row for each rank wanted: its bounds, the rows below them and within.
        wanted = ends.where("n > 0").select(*keys, F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("within"))
        whole = [*keys, "lo", "hi"]
        ended = None
        while True:
            wanted = checkpointed(wanted)
            end = wanted.where((F.col("lo") == F.col("hi")) | (F.col("within") <= ordered))
            ended = end if ended is None else ended.unionByName(end)
            wanted = wanted.where((F.col("lo") < F.col("hi")) & (F.col("within") > ordered))
            if wanted.isEmpty():
                break
            width = F.col("hi") - F.col("lo")
            # Halved where the width exceeds the largest double.
            share = F.when(width < float("inf"), (F.col("v") - F.col("lo")) / width).otherwise((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
            held = inside(wanted).groupBy(*whole, F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
            held = held.withColumn("up", F.sum("n").over(Window.partitionBy(*whole).orderBy("bin"))).withColumnsRenamed({c: f"{c}_h" for c in whole})
            place = F.col("k") - F.col("below")
            found = wanted.join(held, [*same(whole, "_h"), place < F.col("up"), place >= F.col("up") - F.col("n")])
            wanted = found.select(*keys, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("up") - F.col("n")).alias("below"), F.col("n").alias("within"))
        few = ended.where("lo < hi")
        placed = inside(few).withColumn("at", F.row_number().over(Window.partitionBy(*whole).orderBy("v")) - 1).withColumnsRenamed({c: f"{c}_h" for c in whole})
        done = few.join(placed, [*same(whole, "_h"), F.col("k") - F.col("below") == F.col("at")]).select(*keys, "k", "v").unionByName(ended.where("lo = hi").select(*keys, "k", F.col("lo").alias("v")))
        values = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values")).withColumnsRenamed({k: f"{k}_v" for k in keys})
        low, high = (lambda h, f=f: F.element_at("values", f(h).cast("bigint")) for f in (F.floor, F.ceil))
        out = F.when(F.col("n") > 0, F.transform(at, lambda h: low(h) + (high(h) - low(h)) * (h - F.floor(h))))
        return checkpointed(ends.join(values, same(keys, "_v"), "left").select(*(F.col(k).alias(c) for k, c in zip(keys, by)), out.alias("quantiles")))
    finally:
        rows.unpersist()


def least_squares(df: DataFrame, features: list[str], responses: list[str]) -> np.ndarray:
    """(1 + features) x responses coefficients, the intercept first, from one aggregation of cross products."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = [F.col(c).cast("double") for c in responses]
    n, m = len(x), len(y)
    cells = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(a * b) for a in x for b in y]
    sums = [v or 0.0 for v in df.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).first()]
    gram = np.zeros((n, n))
    gram[np.triu_indices(n)] = sums[: n * (n + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    return np.linalg.lstsq(gram, np.array(sums[n * (n + 1) // 2 :]).reshape(n, m), rcond=None)[0]


def running_mean(df: DataFrame, order: str, value: str, k: int = 100, key: str = "seq_id", buckets: int | None = None, out_col: str = "smooth", block: int = 200_000) -> DataFrame:
    """Centred mean of ``value`` over k neighbours in the order of ``order`` (then key), partial at the ends.

    Rows are exchanged by ranges of (order, key), so rows of one order value are split
    too; a row's rank is its place in its range and the rows of the ranges before.
    Blocks of ``block`` ranks (k at least) then take the k ranks around them along: no
    task holds more than a range or a block, and the plan doesn't grow with their number.
    """
    before, after = (k - 1) // 2, k - 1 - (k - 1) // 2
    block = max(block, k)
    if buckets is None:
        buckets = max(1, -(-df.count() // 200_000))
    placed = df.repartitionByRange(buckets, order, key).sortWithinPartitions(order, key)
    # The number of a row: its range in the upper bits, its place in the lower 33.
    placed = checkpointed(placed.withColumn("__at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftrightunsigned("__at", 33).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    ranges = ranges.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    ranks = placed.withColumn("__range", F.shiftrightunsigned("__at", 33)).join(ranges, "__range")
    ranks = ranks.withColumn("__rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__range", "__before")
    own = F.floor(F.col("__rank") / block)
    place = F.col("__rank") - own * block
    into = F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.when(place < after, F.struct((own - 1).alias("b"), F.lit(False).alias("own"))), F.when(place >= block - before, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
    spread = ranks.withColumn("__to", F.explode(F.filter(into, lambda x: x.isNotNull())))
    w = Window.partitionBy("__to.b").orderBy("__rank").rowsBetween(-before, after)
    return spread.withColumn(out_col, F.avg(value).over(w)).where("__to.own").drop("__rank", "__to")
