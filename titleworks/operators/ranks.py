"""Ranks over a whole table without one task seeing it all.

A window without a partition puts every row in one task. Here rows are sorted across the cluster
(equal values are split by the tie-break columns, so a hot value does not fill one task), settled
in the shared folder, and numbered inside each sorted part; only one total per part is combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.session import settle

_PART_BITS = 33  # monotonically_increasing_id() = part number << 33 | position in the part


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Number all rows 1..n in a total order."""
    settled = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART_BITS)
    first = _running(settled.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")))
    position = F.col("_at") - F.shiftleft(F.col("_part"), _PART_BITS)
    return (
        settled.withColumn("_part", part)
        .join(F.broadcast(first), "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_part", "_before", "_at")
    )


def running_totals(df: DataFrame, order: list[Column], weight: str, name: str = "before") -> DataFrame:
    """The sum of `weight` over all rows that come earlier in a total order.

    Each sorted part is one window group: the sort sizes the parts evenly.
    """
    settled = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = settled.withColumn("_part", F.shiftright("_at", _PART_BITS))
    first = _running(parts.groupBy("_part").agg(F.sum(weight).alias("_n")))
    earlier = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    return (
        parts.withColumn("_inside", inside)
        .join(F.broadcast(first), "_part")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_before", "_inside", "_at")
    )


def _running(parts: DataFrame) -> DataFrame:
    """Totals of the earlier parts. One row per sorted part: at most the shuffle's part count."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def ntile(df: DataFrame, order: list[Column], tiles: int, name: str) -> DataFrame:
    """NTILE over the whole table: the first n % tiles groups hold one row more."""
    numbered = row_numbers(df, order, "_row")
    small, extra = divmod(numbered.count(), tiles)
    in_large = extra * (small + 1)
    row = F.col("_row") - 1
    tile = F.when(row < in_large, F.floor(row / (small + 1)) + 1).otherwise(
        extra + F.floor((row - in_large) / max(small, 1)) + 1
    )
    return numbered.withColumn(name, tile.cast("bigint")).drop("_row")


def average_ranks(counts: DataFrame, value: str, n: str, bounded: bool, name: str = "avg_rank") -> DataFrame:
    """Average rank of every distinct value, from a table of (value, how often).

    `bounded` says the values come from a fixed small set (such as scores with two decimals), so
    a plain window is enough; otherwise the totals run across the sorted parts.
    """
    if bounded:
        earlier = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("_earlier", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    else:
        ranked = running_totals(counts, [F.col(value)], n, "_earlier")
    return ranked.withColumn(name, F.col("_earlier") + (F.col(n) + 1) / 2).drop("_earlier")


def top_with_ties(df: DataFrame, value: str, limit: int, rank: str) -> DataFrame:
    """Rows whose RANK by `value`, highest first, is at most `limit`; ties at the end are kept.

    Only the best `limit` values are ever ranked (rows at a value are counted, not moved), so
    ties of any size stay spread out.
    """
    best = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.col(value).desc())
        .limit(limit)
    )
    better = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = best.select(value, (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).alias(rank))
    # At most `limit` rows, a parameter.
    return df.join(F.broadcast(ranks.where(F.col(rank) <= limit)), value)
