"""Merging a batch of clean records into the stored tables.

Every function takes the stored frame and the batch and returns the new state, so a load can be
repeated (the result does not change) and written beside the old one before anything reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.operators.cleaning import last_per_key
from titleworks.schemas import TAG_ALIASES, TITLE_COLUMNS


def merge_by_key(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows replace stored rows with the same key; the others stay.

    Both sides are unique by key, so this is one shuffle and an aggregate, with no join.
    """
    sides = stored.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    return last_per_key(sides, key, "_side").drop("_side")


def union_sources(*sources: DataFrame, key: str = "mal_id", order: str = "_seq") -> DataFrame:
    """Several prepared sources as one: a later source overrides an earlier one."""
    ranked = [s.drop(order).withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    together = ranked[0]
    for source in ranked[1:]:
        together = together.unionByName(source)
    return last_per_key(together, key, "_priority").drop("_priority")


def upsert_titles(stored: DataFrame | None, records: DataFrame, now: Column) -> DataFrame:
    batch = records.select(*TITLE_COLUMNS, now.alias("updated_at"))
    return batch if stored is None else merge_by_key(stored, batch, "mal_id")


def merge_tags(stored: DataFrame | None, reference: DataFrame) -> DataFrame:
    return reference if stored is None else merge_by_key(stored, reference, "genre_id")


def batch_companies(records: DataFrame, order: str = "_seq") -> DataFrame:
    """Company names of a batch with the first id that is known for them."""
    credits = records.select(F.col(order).alias("_row"), F.posexplode("companies").alias("_at", "c"))
    first_known = F.min_by("c.mal_id", F.when(F.col("c.mal_id").isNotNull(), F.struct("_row", "_at")))
    return credits.groupBy(F.col("c.name").alias("name")).agg(first_known.alias("mal_id"))


def merge_companies(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A company's id is filled in when a batch knows it and is never erased by one that does not.

    company_id comes from the name, so it is the same in every run and on every executor.
    """
    new = batch.select("name", F.col("mal_id").alias("new_id"))
    if stored is None:
        merged = new.withColumnRenamed("new_id", "mal_id")
    else:
        merged = (
            stored.select("name", "mal_id")
            .join(new, "name", "full_outer")
            .select("name", F.coalesce("new_id", "mal_id").alias("mal_id"))
        )
    return merged.select(F.xxhash64("name").alias("company_id"), "mal_id", "name")


def match_tags(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Every tag of every title with the id its name (or its current name) has, or null."""
    old_names: dict[str, list[str]] = {}
    for old, current in TAG_ALIASES.items():
        old_names.setdefault(current, []).append(old)
    older = F.create_map(*[x for current, old in old_names.items() for x in (F.lit(current), F.array(*map(F.lit, old)))])
    names = reference.select("name", "genre_id", F.lit(False).alias("old")).union(
        reference.select(F.explode(F.try_element_at(older, F.col("name"))), "genre_id", F.lit(True))
    )
    ids = names.groupBy("name").agg(F.min_by("genre_id", "old").alias("genre_id"))  # a name's own id comes first
    tags = records.select("mal_id", F.posexplode("tags").alias("position", "name"))
    return tags.join(ids, "name", "left").select("mal_id", "position", "name", "genre_id")


def tag_links(matched: DataFrame) -> DataFrame:
    return (
        matched.where("genre_id is not null")
        .select(F.col("mal_id").alias("anime_id"), "genre_id")
        .distinct()
    )


def unmatched_tags(matched: DataFrame) -> DataFrame:
    return matched.where("genre_id is null").groupBy("name").agg(F.count("*").alias("titles"))


def company_links(records: DataFrame) -> DataFrame:
    return (
        records.select(F.col("mal_id").alias("anime_id"), F.inline("companies").alias("name", "role", "_"))
        .select("anime_id", F.xxhash64("name").alias("company_id"), "role")
        .distinct()
    )


def replace_links(stored: DataFrame | None, touched: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the touched titles (a column anime_id, unique) are replaced; the others stay."""
    if stored is None:
        return links.distinct()
    kept = stored.join(touched.select("anime_id"), "anime_id", "left_anti")
    return kept.unionByName(links.select(*stored.columns).distinct())


def quality_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per rule: allowed values, unique keys, and links that point nowhere."""
    titles, tags, companies = tables["titles"], tables["tags"], tables["companies"]
    tag_links_, company_links_ = tables["title_tags"], tables["title_companies"]

    def allowed(name: str, df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
        bad = F.col(column).isNotNull() & ~F.col(column).isin(*values)
        return df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    def unique(name: str, df: DataFrame, *key: str) -> DataFrame:
        repeats = df.dropna(subset=list(key)).groupBy(*key).agg((F.count("*") - 1).alias("extra"))
        total = F.coalesce(F.sum("extra"), F.lit(0).cast("bigint"))
        return repeats.agg(total.alias("violations")).select(F.lit(name).alias("rule"), "violations")

    def points(name: str, df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
        # Count per value first: a value with very many links crosses the shuffle as one row.
        used = df.groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"))
        lost = used.join(target.select(key).distinct(), key, "left_anti")
        total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
        return lost.agg(total.alias("violations")).select(F.lit(name).alias("rule"), "violations")

    rules = [
        allowed("title season", titles, "season", ("winter", "spring", "summer", "fall")),
        allowed("title data source", titles, "data_source", ("kaggle", "api")),
        allowed("tag kind", tags, "kind", ("genre", "explicit_genre", "theme", "demographic")),
        allowed("company role", company_links_, "role", ("studio", "producer", "licensor")),
        unique("title id", titles, "mal_id"),
        unique("tag name", tags, "name"),
        unique("company name", companies, "name"),
        unique("company source id", companies, "mal_id"),
        unique("tag link", tag_links_, "anime_id", "genre_id"),
        unique("company link", company_links_, "anime_id", "company_id", "role"),
        points("tag link title", tag_links_, "anime_id", titles.withColumnRenamed("mal_id", "anime_id"), "anime_id"),
        points("tag link tag", tag_links_, "genre_id", tags, "genre_id"),
        points("company link title", company_links_, "anime_id", titles.withColumnRenamed("mal_id", "anime_id"), "anime_id"),
        points("company link company", company_links_, "company_id", companies, "company_id"),
    ]
    table = rules[0]
    for rule in rules[1:]:
        table = table.unionByName(rule)
    return table


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    total = counts[0]
    for count in counts[1:]:
        total = total.unionByName(count)
    return total
