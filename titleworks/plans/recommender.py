"""Content-based picks: similar titles from text and tags, and the numbers that judge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.functions import titles as K
from titleworks.operators import text_vectors as V
from titleworks.operators.tiles import CANDIDATE_BLOCK, QUERY_BLOCK, best_pairs
from titleworks.plans.marts import POST_RELEASE_TAGS, watched
from titleworks.session import settle

TOP = 10
# Picks taken per wanted slot before repeats of a series go.
POOL = 5
# Tag families used, and titles to read by eye.
TAG_KINDS = ("genre", "theme", "demographic")
SPOT_CHECK_IDS = (52991, 5114, 9253, 16498, 1)


def usable_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Tag links of the stored tables, as (mal_id, tag, kind)."""
    links = tables["title_tags"].join(tables["tags"], "genre_id")
    return usable_tags(links.select(F.col("anime_id").alias("mal_id"), F.col("name").alias("tag"), "kind"))


def usable_tags(links: DataFrame) -> DataFrame:
    """Genre, theme and demographic links, without tags given after release."""
    return links.where(F.col("kind").isin(*TAG_KINDS) & ~F.col("tag").isin(*POST_RELEASE_TAGS))


def profiles(
    titles: DataFrame,
    links: DataFrame,
    max_terms: int = V.MAX_TERMS,
    stop_words: tuple[str, ...] = V.STOP_WORDS,
) -> DataFrame:
    """One settled row per title: text vector, tags, series keys, and whether it may be picked."""
    counts = settle(V.term_counts(titles, stop_words), "terms")
    vocab = V.vocabulary(counts, titles.count(), max_terms)
    title = F.col("title")
    rows = (
        titles.select(
            "mal_id",
            "title",
            watched().alias("eligible"),
            K.series_rule(title).alias("series_rule"),
            K.series_codes(title).alias("series_codes"),
            K.slot_key(title, F.col("mal_id")).alias("slot"),
            V.usable_text(F.col("synopsis")).isNotNull().alias("has_synopsis"),
            V.is_placeholder(F.col("synopsis")).alias("placeholder"),
        )
        .join(V.text_vectors(counts, vocab), "mal_id", "left")
        .join(V.tag_sets(usable_tags(links)), "mal_id", "left")
    )
    return settle(rows, "profiles")


def series_sizes(rows: DataFrame) -> DataFrame:
    """How many candidates each title's series hides from it.

    Counted by key and joined on equal keys: a one-word title hides every title that starts
    with the word, a longer one those with the same first two words.
    """
    sizes = rows.where("eligible").select(F.explode("series_codes").alias("series_rule")).groupBy("series_rule").agg(F.count("*").alias("same"))
    own = (F.col("eligible") & F.col("series_rule").isNotNull()).cast("bigint")
    hidden = F.coalesce(F.when(F.col("series_rule").isNotNull(), F.col("same")), F.lit(0))
    return rows.join(sizes, "series_rule", "left").select("mal_id", (hidden - own).alias("hidden"))


def one_per_slot(ranked: DataFrame, k: int) -> DataFrame:
    """The best pick of every series in each list, then the first k (at most a pool per list)."""
    order = [F.desc("score"), F.col("similar_id")]
    first = F.row_number().over(Window.partitionBy("anime_id", "slot").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("anime_id").orderBy(*order))
    kept = ranked.withColumn("first", first).where("first = 1").drop("first")
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    k: int = TOP,
    query_ids: list[int] | None = None,
    skip_series: bool = True,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    asking: Column | None = None,
) -> DataFrame:
    """Up to k picks per title with both cosines: (anime_id, rank, similar_id, similarity, ...).

    Any title can ask (all do, or those with `query_ids` or for which `asking` is true); only eligible ones are picked, never the title itself, one of its own
    series, two of one series, or a title it shares nothing with.
    """
    queries = rows if query_ids is None else rows.where(F.col("mal_id").isin(*query_ids))
    queries = queries if asking is None else queries.where(asking)
    pool = POOL * k if skip_series else k
    best = best_pairs(queries, rows.where("eligible"), pool, skip_series, query_block, candidate_block, k if skip_series else None)
    if skip_series:
        picks = one_per_slot(best, k)
    else:
        rank = F.row_number().over(Window.partitionBy("anime_id").orderBy(F.desc("score"), "similar_id"))
        picks = best.withColumn("rank", rank)
    return picks.select(
        "anime_id",
        F.col("rank").cast("bigint").alias("rank"),
        "similar_id",
        F.bround(F.col("score").cast("double"), 4).cast("float").alias("similarity"),
        "text_cosine",
        "tag_cosine",
    )


def recommendations(picks: DataFrame) -> DataFrame:
    return picks.select("anime_id", "rank", "similar_id", "similarity")


def pair_cosines(recs: DataFrame, rows: DataFrame) -> DataFrame:
    """Text and tag cosine of given pairs, by joining each pair's own terms (linear in the pairs)."""
    pairs = recs.select("anime_id", "similar_id")
    terms = V.unpack_text(rows.where("term_ids is not null"))
    asked = pairs.join(terms.withColumnRenamed("mal_id", "anime_id"), "anime_id")
    other = terms.select(F.col("mal_id").alias("similar_id"), "term_id", F.col("weight").alias("other"))
    text = (
        asked.join(other, ["similar_id", "term_id"])
        .groupBy("anime_id", "similar_id")
        .agg(F.sum(F.col("weight") * F.col("other")).alias("text_cosine"))
    )
    tags = rows.where("tags is not null").select("mal_id", "tags")
    shared = F.size(F.array_intersect("tags", "other_tags")) / F.sqrt(F.size("tags") * F.size("other_tags"))
    tag = (
        pairs.join(tags.withColumnRenamed("mal_id", "anime_id"), "anime_id")
        .join(tags.select(F.col("mal_id").alias("similar_id"), F.col("tags").alias("other_tags")), "similar_id")
        .select("anime_id", "similar_id", shared.alias("tag_cosine"))
    )
    return (
        pairs.join(text, ["anime_id", "similar_id"], "left")
        .join(tag, ["anime_id", "similar_id"], "left")
        .fillna(0.0, ["text_cosine", "tag_cosine"])
    )


def tag_overlap(recs: DataFrame, genres: DataFrame) -> DataFrame:
    """Share of picks with at least one genre in common with their title (titles with genres only)."""
    sets = genres.groupBy("mal_id").agg(F.collect_set("tag").alias("tags"))
    other = sets.select(F.col("mal_id").alias("similar_id"), F.col("tags").alias("other_tags"))
    scored = recs.join(sets.withColumnRenamed("mal_id", "anime_id"), "anime_id").join(other, "similar_id", "left")
    shares = F.coalesce(F.arrays_overlap("tags", "other_tags"), F.lit(False))
    return scored.agg(F.coalesce(F.avg(shares.cast("double")), F.lit(0.0)).alias("tag_overlap_at_10"))


def evaluation(rows: DataFrame, picks: DataFrame, links: DataFrame, k: int = TOP) -> DataFrame:
    """One row of facts about the titles and their picks."""
    facts = rows.agg(
        F.count("*").alias("titles"),
        F.count_if("eligible").alias("recommendable_titles"),
        F.count_if(~F.col("has_synopsis")).alias("titles_without_synopsis"),
        F.count_if("placeholder").alias("placeholder_synopses"),
    )
    features = rows.select(F.explode("term_ids").alias("t")).agg(F.count_distinct("t").alias("text_features"))
    tag_features = rows.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("tag_features"))
    # A title without picks counts as a list of 0.
    lists = picks.groupBy(F.col("anime_id").alias("mal_id")).agg(F.count("*").alias("n"))
    short = (
        rows.select("mal_id")
        .join(lists, "mal_id", "left")
        .agg(F.count_if(F.coalesce("n", F.lit(0)) < k).alias("titles_with_fewer_than_k"))
    )
    # Cosines are rounded first: exact medians then keep few distinct values per task.
    median = lambda c: F.round(F.median(F.round(c, 6)), 3)
    of_picks = picks.agg(
        F.count("*").alias("recommendation_rows"),
        F.count_distinct("similar_id").alias("distinct_picks"),
        median("text_cosine").alias("median_text_cosine"),
        median("tag_cosine").alias("median_tag_cosine"),
    )
    overlap = tag_overlap(picks, usable_tags(links).where("kind = 'genre'"))
    one_row = facts.withColumn("_one", F.lit(1))
    for part in (features, tag_features, short, of_picks, overlap):
        one_row = one_row.join(part.withColumn("_one", F.lit(1)), "_one")
    share = lambda total: F.coalesce(F.round(F.try_divide(F.col("distinct_picks"), F.col(total)), 4), F.lit(0.0))
    return one_row.select(
        *facts.columns, "text_features", "tag_features", "recommendation_rows", "titles_with_fewer_than_k",
        F.round("tag_overlap_at_10", 4).alias("tag_overlap_at_10"),
        share("recommendable_titles").alias("coverage_of_recommendable"),
        share("titles").alias("coverage_of_all_titles"),
        "median_text_cosine", "median_tag_cosine",
    )


def spot_checks(picks: DataFrame, titles: DataFrame, ids: list[int], top: int = 5) -> DataFrame:
    """The first picks' titles for listed titles that exist, in order."""
    names = titles.select("mal_id", "title")
    asked = names.where(F.col("mal_id").isin(*ids))
    best = (
        picks.where(F.col("anime_id").isin(*ids) & (F.col("rank") <= top))
        .join(names.select(F.col("mal_id").alias("similar_id"), F.col("title").alias("pick")), "similar_id")
        .groupBy(F.col("anime_id").alias("mal_id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "pick"))).alias("p"))
    )
    none = F.array().cast("array<string>")
    return asked.join(best, "mal_id", "left").select("mal_id", "title", F.coalesce("p.pick", none).alias("picks"))
