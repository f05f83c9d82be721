"""Rank statistics from counts.

The big tables are scanned once into cells, the number of titles per (factor, group, score).
Scores have two decimals, so a factor has at most some thousand cells per group however many
titles there are, and a group that holds a third of all titles is combined before the shuffle.
Medians, intervals and tests are then small aggregates of the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.functions.probability import interval_ranks, resample_medians
from titleworks.operators.ranks import running_totals
from titleworks.session import unbounded


def category_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Titles per (factor, group, score) for several category columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("group")) for c in columns])
    return (
        df.select("score", F.inline(pairs))
        .where(F.col("group").isNotNull())
        .groupBy("factor", "group", "score")
        .agg(F.count("*").alias("n"))
    )


def tag_cells(scored_tags: DataFrame, everyone: DataFrame, factors: list[str]) -> DataFrame:
    """Cells with group "true"/"false" for having each tag.

    scored_tags has one row per link (factor, score); everyone is (score, n) over all titles.
    Titles without a tag are all titles minus those with it: no title x tag product is built.
    """
    having = scored_tags.groupBy("factor", "score").agg(F.count("*").alias("with"))
    every = everyone.select(F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"), "score", "n")
    both = every.join(having, ["factor", "score"], "left").withColumn("with", F.coalesce("with", F.lit(0)))
    sides = F.array(
        F.struct(F.lit("true").alias("group"), F.col("with").cast("bigint").alias("n")),
        F.struct(F.lit("false").alias("group"), (F.col("n") - F.col("with")).alias("n")),
    )
    return both.select("factor", "score", F.inline(sides)).where("n > 0").select("factor", "group", "score", "n")


def pair_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Titles per (factor, x, score) for several number columns; titles lacking x are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in columns])
    return (
        df.select("score", F.inline(pairs))
        .where(F.col("x").isNotNull() & F.col("score").isNotNull())
        .groupBy("factor", "x", "score")
        .agg(F.count("*").alias("n"))
    )


def group_medians(cells: DataFrame, *keys: str) -> DataFrame:
    """n, median and the median's bootstrap interval per group."""
    keys = keys or ("factor", "group")
    upto = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("upto", F.sum("n").over(upto))
    sizes = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.percentile("score", 0.5, F.col("n")).alias("median"),
        F.sort_array(F.collect_list(F.struct("upto", "score"))).alias("steps"),
    )
    ranks = sizes.withColumn("ranks", interval_ranks("n"))

    def at(index: int) -> Column:
        reached = F.filter("steps", lambda s: s["upto"] >= F.col("ranks")[index])
        return F.element_at(reached, 1)["score"]

    low, high = (at(0) + at(1)) / 2, (at(2) + at(3)) / 2
    return ranks.select(*keys, "n", "median", low.alias("ci_low"), high.alias("ci_high"))


def resampled_medians(cells: DataFrame, *keys: str, resamples: int = 1000, seed: int = 0, share: float = 0.95) -> DataFrame:
    """n and the middle `share` of the medians of seeded resamples, per group.

    Cells are resampled, not titles: a group of any size costs its number of different scores. Same seed, same limits.
    """
    keys = keys or ("factor", "group")
    sizes = cells.groupBy(*keys, "score").agg(F.sum("n").alias("n")).where("n > 0")
    groups = sizes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("score", "n"))).alias("cells"))
    medians = resample_medians(resamples, seed)(F.xxhash64(*keys), F.col("cells.score").cast("array<double>"), F.col("cells.n"))
    ordered = groups.select(*keys, "n", F.array_sort(medians).alias("medians"))

    def at(part: float) -> Column:
        place = part * (resamples - 1)
        low, over = int(place), place - int(place)
        first, second = F.get("medians", F.lit(low)), F.get("medians", F.lit(min(low + 1, resamples - 1)))
        return first + (second - first) * over

    return ordered.select(*keys, "n", at((1 - share) / 2).alias("ci_low"), at((1 + share) / 2).alias("ci_high"))


def kruskal(cells: DataFrame) -> DataFrame:
    """Kruskal-Wallis per factor, corrected for ties: (n - 1) x between / total rank variation."""
    values = cells.groupBy("factor", "score").agg(F.sum("n").alias("t"))
    earlier = Window.partitionBy("factor").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("rank", F.coalesce(F.sum("t").over(earlier), F.lit(0)) + (F.col("t") + 1) / 2)
    totals = ranks.groupBy("factor").agg(F.sum("t").alias("n"), F.collect_list(F.struct("t", "rank")).alias("r"))
    middle = (F.col("n") + 1) / 2
    spread = F.aggregate(
        "r", F.lit(0.0), lambda s, x: s + x["t"] * (x["rank"] - middle) * (x["rank"] - middle)
    )
    totals = totals.select("factor", "n", spread.alias("total"))
    groups = (
        cells.join(ranks.select("factor", "score", "rank"), ["factor", "score"])
        .groupBy("factor", "group")
        .agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("rank")).alias("ranks"))
        .join(totals, "factor")
    )
    gap = F.col("ranks") / F.col("size") - middle
    between = groups.groupBy("factor", "n", "total").agg(
        F.sum(F.col("size") * gap * gap).alias("between"), F.count("*").alias("groups")
    )
    effect = F.when(F.col("groups") > 1, F.try_divide(F.col("between"), F.col("total")))
    return between.select(
        "factor", "n", "groups", ((F.col("n") - 1) * effect).alias("statistic"), effect.alias("effect_size")
    )


def spearman(cells: DataFrame) -> DataFrame:
    """Spearman's rho of x and score per factor; its square is the effect size."""
    xs = running_totals(cells.groupBy("factor", "x").agg(F.sum("n").alias("t")), [F.col("factor"), F.col("x")], "t")
    # One row per factor.
    start = xs.groupBy("factor").agg(F.min("before").alias("start"), F.sum("t").alias("total"))
    xs = xs.join(F.broadcast(start), "factor").select(
        "factor", "x", "total", (F.col("before") - F.col("start") + (F.col("t") + 1) / 2).alias("rank_x")
    )
    earlier = Window.partitionBy("factor").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ys = cells.groupBy("factor", "score").agg(F.sum("n").alias("t"))
    rank_y = F.coalesce(F.sum("t").over(earlier), F.lit(0)) + (F.col("t") + 1) / 2
    ys = ys.select("factor", "score", rank_y.alias("rank_y"))
    ranked = cells.join(unbounded(xs), ["factor", "x"]).join(ys, ["factor", "score"])
    dx = F.col("rank_x") - (F.col("total") + 1) / 2
    dy = F.col("rank_y") - (F.col("total") + 1) / 2
    sums = ranked.groupBy("factor").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * dx * dy).alias("xy"),
        F.sum(F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("n") * dy * dy).alias("yy"),
    )
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    # A perfect ranking may come out a rounding error beyond 1.
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))
    return sums.select("factor", "n", rho.alias("statistic"), (rho * rho).alias("effect_size"))


def adjust_p_values(tests: DataFrame, p: str = "p_value", order: str = "factor", name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg over a table of tests (as many rows as factors, never data-sized).

    Equal p-values get equal results, so the tie order does not matter.
    """
    count = F.count(p).over(Window.partitionBy())
    up = Window.orderBy(F.col(p).asc_nulls_last(), order)
    scaled = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_raw", F.col(p) * count / F.col("_rank"))
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))
    return scaled.withColumn(name, adjusted).drop("_rank", "_raw")
