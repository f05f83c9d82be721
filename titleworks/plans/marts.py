"""The analysis population and the tables the four questions read.

Tables: titles, tags (genre_id, name, kind), title_tags (anime_id, genre_id),
companies (company_id, mal_id, name), title_companies (anime_id, company_id, role).

No join carries a broadcast hint: the lookups are small in practice but nothing bounds them, so
the choice is left to Spark, which checks the size. What has a row per title is never sent whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.operators.ranks import ntile, top_with_ties
from titleworks.session import unbounded

MIN_MEMBERS = 1000
NOT_AIRED = "Not yet aired"
TOP_STUDIOS = 15
TOP_SCORES = 250
# Fixed values.
CATEGORICAL_FACTORS = ("type", "source", "rating", "season", "demographic", "studio_group")
NUMERIC_FACTORS = ("episodes", "duration_min", "year")
POST_RELEASE_TAGS = ("Award Winning",)
BIN_EDGES = {
    "episodes": ((1, "1"), (6, "2-6"), (13, "7-13"), (26, "14-26"), (52, "27-52"), (None, "53+")),
    "duration_min": ((4, "1-4"), (14, "5-14"), (29, "15-29"), (59, "30-59"), (None, "60+")),
}


def scored() -> Column:
    return F.col("score").isNotNull()


def watched() -> Column:
    return scored() & (F.coalesce(F.col("members"), F.lit(0)) >= MIN_MEMBERS)


def in_population() -> Column:
    return watched() & ~F.col("status").eqNullSafe(NOT_AIRED)


def population(titles: DataFrame) -> DataFrame:
    return titles.where(in_population())


def filter_counts(titles: DataFrame) -> DataFrame:
    """How many titles survive each population filter, in order; one scan."""
    return titles.agg(
        F.count("*").alias("in_database"),
        F.count_if(scored()).alias("has_score"),
        F.count_if(watched()).alias("enough_members"),
        F.count_if(in_population()).alias("has_aired"),
    )


def catalog(titles: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Every title with its tag and studio names as sorted lists (empty when it has none)."""
    tags = (
        tables["title_tags"]
        .join(tables["tags"].select("genre_id", "name"), "genre_id")
        .groupBy(F.col("anime_id").alias("mal_id"))
        .agg(F.sort_array(F.collect_list("name")).alias("genres"))
    )
    studios = (
        tables["title_companies"]
        .where("role = 'studio'")
        .join(tables["companies"].select("company_id", "name"), "company_id")
        .groupBy(F.col("anime_id").alias("mal_id"))
        .agg(F.sort_array(F.collect_list("name")).alias("studios"))
    )
    none = F.array().cast("array<string>")
    return (
        titles.select("mal_id", "title", "title_english", "type", "year", F.col("score").cast("double"), "members")
        .join(unbounded(tags), "mal_id", "left")
        .join(unbounded(studios), "mal_id", "left")
        .withColumn("genres", F.coalesce("genres", none))
        .withColumn("studios", F.coalesce("studios", none))
    )


def question_tags(pop: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Genre and theme tags of every population title, one row per link."""
    wanted = tables["tags"].where(F.col("kind").isin("genre", "theme"))
    return (
        tables["title_tags"]
        .join(wanted, "genre_id")
        .join(unbounded(pop.select(F.col("mal_id").alias("anime_id"))), "anime_id", "left_semi")
        .select(F.col("anime_id").alias("mal_id"), F.col("name").alias("tag"), "kind")
    )


def studio_links(pop: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return (
        tables["title_companies"]
        .where("role = 'studio'")
        .join(unbounded(pop.select(F.col("mal_id").alias("anime_id"))), "anime_id", "left_semi")
        .select("anime_id", "company_id")
    )


def studio_ranks(links: DataFrame, companies: DataFrame) -> DataFrame:
    """Studios by number of population titles, ties by name.

    Only the studios in the top group keep a number; every other one is ordered by its own
    (count, name), which is enough to pick a title's main studio and needs no global window.
    """
    counts = links.groupBy("company_id").agg(F.count("*").alias("titles"))
    return counts.join(companies.select("company_id", "name"), "company_id")


def main_studio(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each title's best-ranked studio: most titles, then name."""
    order = F.struct((-F.col("titles")).alias("n"), F.col("name").alias("name"), F.col("company_id").alias("id"))
    best = F.min(order).alias("best")
    return (
        links.join(ranks, "company_id")
        .groupBy("anime_id")
        .agg(best)
        .select(F.col("anime_id").alias("mal_id"), F.col("best.id").alias("company_id"), F.col("best.name").alias("name"))
    )


def top_studios(ranks: DataFrame, top: int = TOP_STUDIOS) -> DataFrame:
    """The `top` studios with their rank; the window sees only those rows."""
    order = [F.col("titles").desc(), F.col("name").asc(), F.col("company_id").asc()]
    best = ranks.orderBy(*order).limit(top)
    return best.withColumn("studio_rank", F.row_number().over(Window.orderBy(*order)))


def demographics(tables: dict[str, DataFrame]) -> DataFrame:
    named = F.when(F.count("*") > 1, "Multiple").otherwise(F.min("name"))
    return (
        tables["title_tags"]
        .join(tables["tags"].where("kind = 'demographic'"), "genre_id")
        .groupBy(F.col("anime_id").alias("mal_id"))
        .agg(named.alias("demographic"))
    )


def factor_frame(titles: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per population title with its pre-release factors and no outcome but the score."""
    pop = population(titles)
    links = studio_links(pop, tables)
    ranks = studio_ranks(links, tables["companies"])
    leaders = top_studios(ranks).select("company_id", F.lit(True).alias("leader"))
    # The leaders are at most TOP_STUDIOS rows.
    main = main_studio(links, ranks).join(F.broadcast(leaders), "company_id", "left")
    group = F.when(F.col("leader"), F.col("name")).otherwise("Other")
    studios = main.select("mal_id", group.alias("studio_group"))
    return (
        pop.join(unbounded(studios), "mal_id", "left")
        .join(unbounded(demographics(tables)), "mal_id", "left")
        .select(
            "mal_id",
            F.col("score").cast("double"),
            *["type", "source", "episodes", "duration_min", "rating", "season", "year"],
            F.coalesce("demographic", F.lit("None")).alias("demographic"),
            F.coalesce("studio_group", F.lit("Unknown")).alias("studio_group"),
        )
    )


def fill_unknown(factors: DataFrame) -> DataFrame:
    """A missing category is a group of its own and not a dropped row."""
    return factors.fillna({c: "Unknown" for c in CATEGORICAL_FACTORS if c in factors.columns})


def member_deciles(pop: DataFrame) -> DataFrame:
    """Ten equal-sized groups by members (1 = least popular)."""
    rows = pop.select("mal_id", F.col("score").cast("double"), "members")
    return ntile(rows, [F.col("members"), F.col("mal_id")], 10, "members_decile")


def top_scores(pop: DataFrame, limit: int = TOP_SCORES) -> DataFrame:
    """The best-scored titles, keeping ties at the end of the list."""
    ranked = top_with_ties(pop.select("mal_id", "score"), "score", limit, "score_rank")
    return ranked.select("mal_id", F.col("score").cast("double"), "score_rank")


def by_year(titles: DataFrame) -> DataFrame:
    """Titles per year in the catalog and the population, with the population's scores.

    The population is a subset of the titles, so this is one pass and no join. Scores are
    counted per value first: a year that holds most rows crosses the shuffle as few rows.
    """
    counts = (
        titles.where("year is not null")
        .select("year", F.when(in_population(), F.col("score").cast("double")).alias("score"))
        .groupBy("year", "score")
        .agg(F.count("*").alias("n"))
    )
    known = F.when(F.col("score").isNotNull(), F.col("n"))
    return counts.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        F.sum("n").alias("titles_in_catalog"),
        F.coalesce(F.sum(known), F.lit(0).cast("bigint")).alias("titles_in_population"),
        F.percentile("score", 0.5, F.col("n")).alias("median_score"),
        (F.sum(F.col("score") * F.col("n")) / F.sum(known)).alias("mean_score"),
    )


def decades(yearly: DataFrame, factors: DataFrame) -> DataFrame:
    """Titles per decade, and the median of the decade's scores (not of its yearly medians)."""
    decade = (F.floor(F.col("year") / 10) * 10).alias("decade")
    counts = yearly.groupBy(decade).agg(
        F.sum("titles_in_catalog").alias("titles_in_catalog"),
        F.sum("titles_in_population").alias("titles_in_population"),
    )
    medians = (
        factors.where("year is not null")
        .groupBy(decade, "score")
        .agg(F.count("*").alias("n"))
        .groupBy("decade")
        .agg(F.percentile("score", 0.5, F.col("n")).alias("median_score"))
    )
    return counts.join(medians, "decade", "left")


def common_tags(tags: DataFrame, genres: int = 15, themes: int = 10) -> DataFrame:
    """The most frequent genres and themes, ties by name, without post-release tags."""
    counts = (
        tags.where(~F.col("tag").isin(*POST_RELEASE_TAGS))
        .where(F.col("kind").isin("genre", "theme"))
        .groupBy("kind", "tag")
        .agg(F.count("*").alias("titles"))
    )
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("titles"), "tag"))
    limit = F.when(F.col("kind") == "genre", genres).otherwise(themes)
    chosen = counts.withColumn("place", place).where(F.col("place") <= F.lit(max(genres, themes)))
    return chosen.where(F.col("place") <= limit).withColumn("factor", F.concat_ws("=", "kind", "tag"))


def bin_label(factor: str) -> Column:
    """Right-closed buckets; null below the first edge."""
    value, label = F.col(factor), F.when(F.col(factor) <= 0, F.lit(None).cast("string"))
    for edge, name in BIN_EDGES[factor]:
        label = label.when(value.isNotNull() if edge is None else value <= edge, name)
    return label
