"""The four questions, answered from one scan of the population into counts.

1. Which pre-release factors go with higher scores?
2. Does popularity go with score?
3. Do tag effects hold inside the top list?
4. How did scores and numbers change over the years?
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.functions.cells import effect_label
from titleworks.functions.probability import rank_test_p
from titleworks.operators import rank_tests as R
from titleworks.operators.regression import design, fit
from titleworks.plans import marts as M
from titleworks.session import settle, unbounded

SIGNIFICANCE = 0.05
# What the answers read of a title.
READ_COLUMNS = ("mal_id", "score", "members", "status", "type", "source", "episodes", "duration_min", "rating", "season", "year")


def numeric_terms() -> dict[str, Column]:
    """Skewed numbers enter as log(1 + x)."""
    return {
        "log1p(episodes)": F.log1p("episodes"),
        "log1p(duration_min)": F.log1p("duration_min"),
        "year": F.col("year").cast("double"),
    }


def chosen_tags(tags: DataFrame, genres: int = 15, themes: int = 10) -> list[str]:
    """The common tags' factor names; at most genres + themes of them."""
    rows = M.common_tags(tags, genres, themes).orderBy("kind", "place").select("factor").collect()
    return [r.factor for r in rows]


def tag_indicators(tags: DataFrame, chosen: list[str]) -> DataFrame:
    """One row per title and chosen tag it has: the true entries of the yes/no table."""
    factor = F.concat_ws("=", "kind", "tag")
    return tags.select("mal_id", factor.alias("factor")).where(F.col("factor").isin(*chosen)).distinct()


def score_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("score").agg(F.count("*").alias("n"))


def tag_effects(cells: DataFrame) -> DataFrame:
    """Median score with and without each tag."""
    medians = R.group_medians(cells)
    side = lambda c, g: F.max(F.when(F.col("group") == g, F.col(c)))
    both = medians.groupBy("factor").agg(
        F.coalesce(side("n", "true"), F.lit(0)).alias("n_with"),
        side("median", "true").alias("median_with"),
        side("ci_low", "true").alias("ci_low_with"),
        side("ci_high", "true").alias("ci_high_with"),
        F.coalesce(side("n", "false"), F.lit(0)).alias("n_without"),
        side("median", "false").alias("median_without"),
    )
    name = F.split("factor", "=", 2)
    return both.select(
        "factor", name[0].alias("kind"), name[1].alias("tag"), *both.columns[1:],
        (F.col("median_with") - F.col("median_without")).alias("difference"),
    )


def range_restriction(everyone: DataFrame, top: DataFrame) -> DataFrame:
    """Each tag's share of all titles and of the top list, and the score gap inside the list.

    Both inputs are cells with groups "true" and "false". Without titles on one side there is
    no gap.
    """
    share = lambda g: F.sum(F.when(F.col("group") == "true", F.col("n")).otherwise(0)) / F.sum("n")
    median = lambda g: F.percentile(F.when(F.col("group") == g, F.col("score")), 0.5, F.col("n"))
    having = F.sum(F.when(F.col("group") == "true", F.col("n")).otherwise(0))
    whole = everyone.groupBy("factor").agg(share("true").alias("share_population"))
    slice_ = top.groupBy("factor").agg(
        share("true").alias("share_top250"),
        having.cast("bigint").alias("n_with_top250"),
        (median("true") - median("false")).alias("difference_top250"),
    )
    return whole.join(slice_, "factor", "left")


def bin_cells(factors: DataFrame) -> DataFrame:
    """Cells of episode and length buckets; titles without a bucket are left out."""
    labelled = factors.select("score", *[M.bin_label(c).alias(c) for c in M.BIN_EDGES])
    return R.category_cells(labelled, list(M.BIN_EDGES))


def bin_order() -> Column:
    """A bucket's place in its factor's natural order."""
    order = F.lit(None).cast("bigint")
    for factor, bins in M.BIN_EDGES.items():
        for i, (_, label) in enumerate(bins):
            order = F.when((F.col("factor") == factor) & (F.col("group") == label), i).otherwise(order)
    return order.cast("bigint")


def numeric_bins(factors: DataFrame) -> DataFrame:
    medians = R.group_medians(bin_cells(factors)).withColumn("order", bin_order())
    return medians.select("factor", "group", "order", "n", "median", "ci_low", "ci_high")


def popularity_deciles(deciles: DataFrame) -> DataFrame:
    cells = R.category_cells(deciles, ["members_decile"])
    ranges = deciles.groupBy(F.col("members_decile").alias("decile")).agg(
        F.min("members").alias("members_min"), F.max("members").alias("members_max")
    )
    medians = R.group_medians(cells).withColumn("decile", F.col("group").cast("bigint"))
    return medians.drop("factor", "group").join(ranges, "decile")


def finish_tests(tests: DataFrame) -> DataFrame:
    """p, adjusted p, effect label and verdict for a table of tests (question, factor, ...)."""
    tests = tests.withColumn("p_value", rank_test_p("test", "statistic", "n", "groups"))
    tests = R.adjust_p_values(tests.withColumn("_key", F.concat_ws(" ", "question", "factor")), order="_key")
    return tests.select(
        "question", "factor", "test", "n", "statistic", "effect_size", "p_value", "p_adjusted",
        effect_label(F.col("effect_size")).alias("effect_label"),
        F.coalesce(F.col("p_adjusted") < SIGNIFICANCE, F.lit(False)).alias("significant"),
    )


def rank_tests(numbers: DataFrame, groups: dict[str, DataFrame]) -> DataFrame:
    """All tests in one table. `groups` maps a question to its cells; numbers are (x, score) cells."""
    labelled = None
    for question, cells in groups.items():
        part = cells.withColumn("factor", F.concat_ws("|", F.lit(question), "factor"))
        labelled = part if labelled is None else labelled.unionByName(part)
    name = F.split("factor", r"\|", 2)
    kruskal = R.kruskal(labelled).select(
        name[0].alias("question"), name[1].alias("factor"), F.lit("kruskal").alias("test"),
        "n", F.col("groups").cast("bigint").alias("groups"), "statistic", "effect_size",
    ).where("groups > 1")
    question = F.when(F.col("factor") == "members", "Q2").otherwise("Q1")
    spearman = R.spearman(numbers).select(
        question.alias("question"), "factor", F.lit("spearman").alias("test"),
        "n", F.lit(0).cast("bigint").alias("groups"), "statistic", "effect_size",
    )
    return kruskal.unionByName(spearman)


@dataclass
class Results:
    """Every result table, and the model's facts."""

    tables: dict[str, DataFrame]
    model_fit: dict
    references: dict[str, str]


def model_frame(factors: DataFrame, indicators: DataFrame) -> DataFrame:
    """Titles with all numbers known, and the chosen tags of each (at most as many as chosen)."""
    sets = indicators.groupBy("mal_id").agg(F.collect_set("factor").alias("tag_set"))
    complete = factors.dropna(subset=list(M.NUMERIC_FACTORS))
    none = F.array().cast("array<string>")
    return complete.join(unbounded(sets), "mal_id", "left").withColumn("tag_set", F.coalesce("tag_set", none))


def regression(factors: DataFrame, indicators: DataFrame, chosen: list[str]) -> tuple[pd.DataFrame, dict, dict]:
    """All factors at once. Returns coefficients, fit facts and reference levels."""
    df = settle(model_frame(factors, indicators), "model")
    flags = {f: F.array_contains("tag_set", f) for f in chosen}
    made = design(df, numeric_terms(), list(M.CATEGORICAL_FACTORS), flags)
    coefficients, facts = fit(df, "mal_id", "score", made)
    facts["rows_dropped"] = factors.count() - facts["n"]
    return coefficients, facts, made.references


def analyze(
    titles: DataFrame, tables: dict[str, DataFrame], genres: int = 15, themes: int = 10, top: int = M.TOP_SCORES
) -> Results:
    """Answer all questions. Titles, their links and the population's frames are settled once and read by every answer."""
    spark = titles.sparkSession
    titles = settle(titles.select(*READ_COLUMNS), "titles")
    tables = {**tables, "title_tags": settle(tables["title_tags"], "title-tags"), "title_companies": settle(tables["title_companies"].where("role = 'studio'"), "studio-links")}
    pop = M.population(titles)
    factors = settle(M.fill_unknown(M.factor_frame(titles, tables)), "factors")
    tags = settle(M.question_tags(pop, tables), "tags")
    chosen = chosen_tags(tags, genres, themes)
    indicators = settle(
        tag_indicators(tags, chosen).join(unbounded(factors.select("mal_id", "score")), "mal_id"), "indicators"
    )
    top_titles = M.top_scores(pop, top)
    top_factors = settle(factors.select("mal_id", "score").join(unbounded(top_titles.select("mal_id")), "mal_id", "left_semi"), "top")
    top_tags = indicators.join(unbounded(top_factors.select("mal_id")), "mal_id", "left_semi")

    categories = settle(R.category_cells(factors, list(M.CATEGORICAL_FACTORS)), "category-cells")
    tag_counts = settle(R.tag_cells(indicators, score_counts(factors), chosen), "tag-cells")
    top_counts = settle(R.tag_cells(top_tags, score_counts(top_factors), chosen), "top-cells")
    members = pop.select(F.col("score").cast("double").alias("score"), "members")
    numbers = R.pair_cells(factors, list(M.NUMERIC_FACTORS)).unionByName(R.pair_cells(members, ["members"]))
    numbers = settle(numbers, "number-cells")
    tests = finish_tests(
        rank_tests(numbers, {"Q1": categories.unionByName(tag_counts), "Q3": top_counts})
    )
    yearly = settle(M.by_year(titles), "years")
    coefficients, facts, references = regression(factors, indicators.drop("score"), chosen)
    facts["population_n"] = factors.count()
    facts["top250_n"] = top_factors.count()
    return Results(
        {
            "tests": settle(tests, "tests"),
            "factor_groups": R.group_medians(categories),
            "tag_effects": tag_effects(tag_counts),
            # One row per term.
            "ols_coefficients": spark.createDataFrame(coefficients),
            "popularity_deciles": popularity_deciles(M.member_deciles(pop)),
            "top250_tags": range_restriction(tag_counts, top_counts),
            "by_year": yearly,
            "by_decade": M.decades(yearly, factors),
            "numeric_bins": numeric_bins(factors),
        },
        facts,
        references,
    )
