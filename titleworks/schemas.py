"""Declared schemas of the landed files and the tables built from them."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns read from the snapshot file, in order. Others are never read.
SNAPSHOT_COLUMNS = [
    "mal_id", "title", "title_english", "type", "source", "episodes", "status", "duration", "rating", "score",
    "scored_by", "members", "favorites", "synopsis", "aired_from", "season", "year", "broadcast_day", "broadcast_time",
    "producers", "licensors", "studios", "genres", "explicit_genres", "themes", "demographics",
]
INTEGER_COLUMNS = ("mal_id", "episodes", "scored_by", "members", "favorites", "year")
# Cell texts that the common CSV readers take as empty.
EMPTY_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The four tag families (service name -> stored kind) and the company roles.
TAG_FAMILIES = {
    "genres": "genre",
    "explicit_genres": "explicit_genre",
    "themes": "theme",
    "demographics": "demographic",
}
COMPANY_ROLES = {"studios": "studio", "producers": "producer", "licensors": "licensor"}
# Old tag names and their current ones.
TAG_ALIASES = {
    "Shoujo Ai": "Girls Love",
    "Shounen Ai": "Boys Love",
    "Cute Girls Doing Cute Things": "CGDCT",
}
DATA_SOURCES = ("kaggle", "api")

# The columns of the stored titles, in order.
TITLE_COLUMNS = [
    "mal_id", "title", "title_english", "type", "source", "episodes", "duration_min", "rating", "synopsis", "season",
    "year", "broadcast_day", "broadcast_time", "status", "score", "scored_by", "members", "favorites", "data_source",
]

NAMED = "array<struct<mal_id: bigint, name: string>>"
PAGE_ITEM = ", ".join(
    ["mal_id: bigint", "episodes: bigint", "scored_by: bigint", "members: bigint"]
    + ["favorites: bigint", "year: bigint", "score: double"]
    + [f"{c}: string" for c in "title title_english type source status duration rating synopsis season".split()]
    + ["aired: struct<from: string>", "broadcast: struct<day: string, time: string>"]
    + [f"{c}: {NAMED}" for c in (*TAG_FAMILIES, *COMPANY_ROLES)]
)
PAGE = f"page int, data array<struct<{PAGE_ITEM}>>, pagination struct<has_next_page: boolean>"
TAG_PAGE = f"family string, data {NAMED}"

TAG_REFERENCE = T.StructType(
    [
        T.StructField("genre_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)
RUNS = (
    "run_id string, started_at timestamp, finished_at timestamp, base_source string, "
    "api_pages_requested bigint, api_pages_failed bigint, anime_upserted bigint, "
    "status string, message string"
)
