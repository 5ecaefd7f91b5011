"""Ranks and running sums without a window over a whole group.

Rows are first summed by cells that follow the order (at most some ten thousand a
group, whatever its size); a window over the cells gives each its offset, and
only the rows of one cell are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    """32 hexadecimal digits that depend on key and seed only, the same in any engine with MD5."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))


def draw_cell(drawn: Column) -> Column:
    """65 536 cells in the order of the draws."""
    return F.substring(drawn, 1, 4)


def ranked(df: DataFrame, by: list[str], cell: Column, order: list[str | Column], rank: str, total: str) -> DataFrame:
    """``df`` with the rank (from 0) of each row in its group and the group's rows.

    ``cell`` must not fall as the order rises. Null groups are groups.
    """
    rows = df.withColumn("__cell", cell)
    keys = [*by, "__cell"]
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), total: F.sum("__n").over(Window.partitionBy(*by))})
    held = held.select(*[F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)], "__before", total)
    same = [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(keys)]
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = rows.withColumn("__here", here).join(held, on=same)
    return joined.withColumn(rank, F.col("__before") + F.col("__here") - 1).drop("__cell", "__here", "__before", *[f"__of_{i}" for i in range(len(keys))])


def running(counts: DataFrame, by: list[str], value: str, cell: Column, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """``counts`` (one row for each group and value) with running sums and totals.

    ``sums``: column -> (name of its sum up to and with the row, name of its sum in the group).
    """
    rows = counts.withColumn("__cell", cell)
    keys = [*by, "__cell"]
    held = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    held = held.select(*keys, *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{up}") for c, (up, _) in sums.items()), *(F.sum(f"__{c}").over(whole).alias(all_) for c, (_, all_) in sums.items()))
    here = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumns({up: F.sum(c).over(here) for c, (up, _) in sums.items()}).join(held, keys)
    return joined.withColumns({up: F.col(up) + F.col(f"__{up}") for up, _ in sums.values()}).drop("__cell", *(f"__{up}" for up, _ in sums.values()))
