"""Landed JSON pages: paged title lists and the tag reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleworks.schemas import PAGE, TAG_FAMILIES, TAG_PAGE, TAG_REFERENCE

# The lists that can be landed, the most popular titles and those of the current season.
TOP, SEASON = "top", "season_now"


def read_pages(spark: SparkSession, folder: str, endpoint: str, pages: int) -> DataFrame:
    """Pages 1..pages of an endpoint, up to the first one that says there are no more.

    A page that was not landed or cannot be read is skipped; failed_pages() lists those.
    """
    return requested_pages(spark.read.schema(PAGE).json(f"{folder}/endpoint={endpoint}"), pages)


def requested_pages(landed: DataFrame, pages: int) -> DataFrame:
    usable = _usable(landed, pages)
    return usable.where(F.col("page") <= _last_page(usable, pages))


def _usable(landed: DataFrame, pages: int) -> DataFrame:
    return landed.where(F.col("page").between(1, pages) & F.col("data").isNotNull())


def _last_page(usable: DataFrame, pages: int) -> int:
    """The first page that ends the list (one number, then a pushed-down filter)."""
    last = usable.where("pagination.has_next_page = false").agg(F.min("page")).first()[0]
    return pages if last is None else last


def page_items(pages: DataFrame) -> DataFrame:
    """One row per title, with its page and its position in the page."""
    return pages.select("page", F.posexplode("data").alias("position", "item"))


def failed_pages(landed: DataFrame, pages: int) -> DataFrame:
    """Pages that were asked for, before the last one, and gave nothing."""
    usable = _usable(landed, pages)
    asked = landed.sparkSession.range(1, _last_page(usable, pages) + 1)
    asked = asked.select(F.col("id").cast("int").alias("page"))
    return asked.join(usable.select("page"), "page", "left_anti")


def read_tag_families(spark: SparkSession, folder: str) -> DataFrame:
    """The tag families as one table. A missing family would be silently wrong, so it fails."""
    landed = spark.read.schema(TAG_PAGE).json(folder)
    return tag_reference(landed)


def tag_reference(landed: DataFrame) -> DataFrame:
    wanted = F.col("family").isin(*TAG_FAMILIES) & F.col("data").isNotNull()
    present = {r[0] for r in landed.where(wanted).select("family").distinct().collect()}  # four at most
    absent = [family for family in TAG_FAMILIES if family not in present]
    if absent:
        raise ValueError(f"tag families not landed: {', '.join(absent)}")
    kinds = F.create_map(*[F.lit(x) for pair in TAG_FAMILIES.items() for x in pair])
    return (
        landed.where(F.col("family").isin(*TAG_FAMILIES))
        .select(F.inline("data"), kinds[F.col("family")].alias("kind"))
        .select(F.col("mal_id").alias("genre_id"), "name", "kind")
    )


def write_tag_reference(reference: DataFrame, path: str) -> None:
    """One small JSON file, ordered by kind and id (a tag list has tens of rows)."""
    reference.orderBy("kind", "genre_id").coalesce(1).write.mode("overwrite").json(path)


def read_tag_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reads JSON lines or one JSON array (the array form with multiLine)."""
    return spark.read.schema(TAG_REFERENCE).option("multiLine", not _is_folder(path)).json(path)


def _is_folder(path: str) -> bool:
    return not path.endswith(".json")
