"""The roles the given tables play, for Spark and for the checking SQL.

titles = orders with their customer, tags = part types, brands and size groups, companies =
suppliers, texts = documents. The column expressions below are plain SQL that both sides read,
and plant the irregularities the jobs must handle (missing values, repeats, messy cells).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE = {
    "mal_id": "o_orderkey",
    "title": "c_name || ' no ' || c_mktsegment || CASE WHEN o_orderkey % 4 = 0 THEN ' (' || CAST(year(o_orderdate) AS STRING) || ')' ELSE '' END",
    "title_english": "CASE WHEN o_orderkey % 5 <> 0 THEN 'The ' || lower(c_mktsegment) || ' of ' || lower(c_name) END",
    "type": "CASE WHEN o_orderkey % 41 <> 1 THEN c_mktsegment END",
    "source": "CASE WHEN o_orderkey % 11 <> 3 THEN o_orderpriority END",
    "episodes": "CASE WHEN o_orderkey % 13 <> 5 THEN 1 + o_custkey % 60 END",
    "duration_min": "CASE WHEN o_orderkey % 17 <> 2 THEN 1 + (o_orderkey * 7) % 90 END",
    "rating": "CASE o_orderkey % 5 WHEN 0 THEN 'G - All Ages' WHEN 1 THEN 'PG - Children' WHEN 2 THEN 'PG-13 - Teens 13 or older' WHEN 3 THEN 'R - 17+' END",
    "synopsis": "CAST(NULL AS STRING)",
    "season": "CASE quarter(o_orderdate) WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' ELSE 'fall' END",
    "year": "CASE WHEN o_orderkey % 19 <> 7 THEN CAST(year(o_orderdate) AS BIGINT) END",
    "broadcast_day": "CASE WHEN o_orderkey % 3 = 0 THEN 'Fridays' END",
    "broadcast_time": "CASE WHEN o_orderkey % 3 = 0 THEN '23:00' END",
    "status": "CASE WHEN o_orderkey % 31 = 4 THEN NULL WHEN o_orderstatus = 'O' THEN 'Currently Airing' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'Not yet aired' ELSE 'Finished Airing' END",
    "score": "CASE WHEN o_orderkey % 10 <> 9 THEN CAST(floor(round(o_totalprice * 100) / 50000) / 100 AS DECIMAL(4,2)) END",
    "scored_by": "CAST(floor(o_totalprice / 100) AS BIGINT)",
    "members": "CASE WHEN o_orderkey % 23 <> 11 THEN CAST(floor(o_totalprice) AS BIGINT) % 9973 + CAST(floor(o_totalprice / 50) AS BIGINT) END",
    "favorites": "CAST(floor(o_totalprice / 5000) AS BIGINT)",
    "data_source": "CASE WHEN o_orderkey % 9 = 4 THEN 'api' ELSE 'kaggle' END",
    "updated_at": "o_orderdate",
}

# One snapshot row per order, as messy text. Row order in the file is the order key.
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
RAW = {
    "mal_id": "CAST(o_orderkey - CASE WHEN o_orderkey % 12 = 7 THEN 1 ELSE 0 END AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END",
    "title": "'  ' || c_name || ' '",
    "title_english": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NaN' ELSE lower(c_name) END",
    "type": "c_mktsegment",
    "source": "CASE WHEN o_orderkey % 7 = 0 THEN 'None' ELSE o_orderpriority END",
    "episodes": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(o_custkey % 50 AS STRING) || '.0' WHEN 2 THEN CAST(o_custkey % 50 AS STRING) ELSE ' ' || CAST(o_custkey % 30 AS STRING) || '.9' END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'Finished Airing' WHEN 'O' THEN 'Currently Airing' ELSE 'Not yet aired' END",
    "duration": "CASE o_orderkey % 9 WHEN 0 THEN CAST(o_custkey % 70 AS STRING) || ' min per ep' WHEN 1 THEN '1 hr ' || CAST(o_custkey % 60 AS STRING) || ' min' WHEN 2 THEN CAST(o_custkey % 60 AS STRING) || ' sec per ep' WHEN 3 THEN 'Unknown' WHEN 4 THEN '' WHEN 5 THEN CAST(o_custkey % 5 AS STRING) || 'hr' WHEN 6 THEN CAST(o_custkey % 9 AS STRING) || ' min 30 sec' WHEN 7 THEN '24 min. per ep.' ELSE '1 hr 10 min 2 hr ' || CAST(o_custkey % 60 AS STRING) || ' sec' END",
    "rating": "CASE o_orderkey % 6 WHEN 0 THEN 'G - All Ages' WHEN 1 THEN 'Rx - Adults' WHEN 2 THEN '' WHEN 3 THEN ' PG - Children' ELSE 'R - 17+' END",
    "score": "CASE WHEN o_orderkey % 8 = 1 THEN '' ELSE CAST(o_custkey % 10 AS STRING) || '.' || CAST(10 + o_orderkey % 90 AS STRING) END",
    "scored_by": "CAST(o_custkey AS STRING) || '.0'",
    "members": "CASE WHEN o_orderkey % 9 = 2 THEN 'NA' ELSE CAST(o_custkey * 3 + o_orderkey % 1700 AS STRING) END",
    "favorites": "CAST(o_orderkey % 100 AS STRING)",
    "synopsis": "'Said \"' || c_name || '\", then' || chr(10) || 'left.'",
    "aired_from": f"CASE o_orderkey % 7 WHEN 0 THEN {_DAY} || 'T00:00:00+00:00' WHEN 1 THEN {_DAY} || 'T23:30:00-09:00' WHEN 2 THEN 'not a date' WHEN 3 THEN '' WHEN 4 THEN {_DAY} WHEN 5 THEN '2021-02-30T00:00:00+00:00' ELSE ' ' || replace({_DAY}, '-', '') || 'T0100Z' END",
    "season": "CASE o_orderkey % 5 WHEN 0 THEN 'Fall' WHEN 1 THEN ' winter ' WHEN 2 THEN 'monsoon' ELSE '' END",
    "year": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(1990 + o_orderkey % 30 AS STRING) || '.0' ELSE '' END",
    "broadcast_day": "CASE WHEN o_orderkey % 3 = 0 THEN 'Fridays' ELSE '' END",
    "broadcast_time": "CASE WHEN o_orderkey % 3 = 0 THEN '23:00' ELSE '' END",
    "producers": "CASE o_orderkey % 4 WHEN 0 THEN c_name || ', Inc., Studio ' || CAST(o_custkey % 40 AS STRING) WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Ltd., A' || CAST(o_custkey % 40 AS STRING) || ', LLC, Inc.,  , B' ELSE '' END",
    "licensors": "CASE WHEN o_orderkey % 5 = 0 THEN 'Pelmora Pictures Co., Ltd., ' || c_name ELSE 'unknown' END",
    "studios": "'Studio ' || CAST(o_custkey % 40 AS STRING) || CASE WHEN o_orderkey % 6 = 0 THEN ', LLC.' ELSE '' END",
    "genres": "CASE o_orderkey % 3 WHEN 0 THEN 'SMALL, Shoujo Ai' WHEN 1 THEN 'Brand#' || CAST(1 + o_custkey % 30 AS STRING) || ',MEDIUM,  Made Up' ELSE 'SMALL, SMALL' END",
    "explicit_genres": "CASE WHEN o_orderkey % 50 = 0 THEN 'Explicit' ELSE '' END",
    "themes": "CASE WHEN o_orderkey % 2 = 0 THEN 'Brand#' || CAST(1 + o_orderkey % 27 AS STRING) ELSE 'Unknown' END",
    "demographics": "CASE WHEN o_orderkey % 4 = 0 THEN 'Group' || CAST(o_orderkey % 5 AS STRING) ELSE '' END",
}

DOC = {
    "mal_id": "doc_id",
    "title": "CASE doc_id % 10 WHEN 0 THEN 'Saga' || CAST(doc_id % 97 AS STRING) WHEN 1 THEN 'The Saga' || CAST(doc_id % 97 AS STRING) || ': Returns' WHEN 2 THEN 'The of' ELSE 'Tale of K' || CAST(doc_id % 251 AS STRING) || ', ' || lang || ' Season ' || CAST(doc_id % 3 AS STRING) END",
    "title_english": "CASE WHEN doc_id % 4 = 0 THEN 'Story ' || source END",
    "type": "CASE WHEN doc_id % 6 = 0 THEN 'Movie' ELSE 'TV' END",
    "year": "CASE WHEN doc_id % 9 <> 0 THEN 1990 + doc_id % 30 END",
    "synopsis": "CASE WHEN doc_id % 29 = 3 THEN NULL WHEN doc_id % 31 = 5 THEN ' No synopsis information has been added to this title.' WHEN doc_id % 37 = 6 THEN '  ' ELSE text END",
    "score": "CASE WHEN quality = 1 THEN CAST(5 + doc_id % 5 AS DOUBLE) END",
    "members": "n_chars * 3",
}


TASK_ROWS = 100_000  # orders that a task makes into text or pages
TASK_LINES = 250_000  # lines whose links a task holds


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


_GENRE = "CASE p_type WHEN 'PROMO' THEN 'Award Winning' WHEN 'LARGE' THEN 'Girls Love' ELSE p_type END"
_GENRE_ID = "length(p_type) * 1000 + ascii(p_type)"
_THEME_ID = "100 + CAST(substring(p_brand, 7) AS BIGINT)"
PART_TAGS = (
    (f"{_GENRE_ID}", _GENRE, "genre", "TRUE"),
    (_THEME_ID, "p_brand", "theme", "TRUE"),
    ("200 + p_size % 4", "'Group' || CAST(p_size % 4 AS STRING)", "demographic", "p_size % 3 = 0"),
    ("900", "'Explicit'", "explicit_genre", "p_size = 50"),
)
ROLE = "CASE l_returnflag WHEN 'A' THEN 'studio' WHEN 'N' THEN 'producer' ELSE 'licensor' END"

# -- the same roles for the checking SQL --------------------------------------------------
TITLES_SQL = f"titles AS (SELECT {_select(TITLE)} FROM orders JOIN customer ON o_custkey = c_custkey)"
RAW_SQL = f"raw AS (SELECT {_select(RAW)}, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey)"
TAGS_SQL = "tags AS (" + " UNION ".join(
    f"SELECT CAST({i} AS BIGINT) AS genre_id, {n} AS name, '{k}' AS kind FROM part WHERE {w}" for i, n, k, w in PART_TAGS
) + ")"
LINKS_SQL = "title_tags AS (" + " UNION ".join(
    f"SELECT l_orderkey AS anime_id, CAST({i} AS BIGINT) AS genre_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {w}"
    for i, _, _, w in PART_TAGS
) + ")"
COMPANIES_SQL = "companies AS (SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey + 5000 END AS mal_id, s_name AS name FROM supplier)"
CREDITS_SQL = f"title_companies AS (SELECT DISTINCT l_orderkey AS anime_id, l_suppkey AS company_id, {ROLE} AS role FROM lineitem)"
POPULATION_SQL = "population AS (SELECT * FROM titles WHERE score IS NOT NULL AND members >= 1000 AND status IS DISTINCT FROM 'Not yet aired')"
BASE_SQL = ",\n".join([TITLES_SQL, TAGS_SQL, LINKS_SQL, COMPANIES_SQL, CREDITS_SQL, POPULATION_SQL])
DOCS_SQL = f"docs AS (SELECT {_select(DOC)}, lang, source, n_chars FROM documents LEFT JOIN labels USING (doc_id))"
DOC_LINKS_SQL = """doc_links AS (
  SELECT mal_id, lang AS tag, 'genre' AS kind FROM docs WHERE mal_id % 13 <> 0
  UNION ALL SELECT mal_id, source, 'theme' FROM docs WHERE mal_id % 7 <> 0
  UNION ALL SELECT mal_id, 'Long', 'demographic' FROM docs WHERE n_chars > 3000
  UNION ALL SELECT mal_id, 'Award Winning', 'genre' FROM docs WHERE mal_id % 17 = 0
  UNION ALL SELECT mal_id, 'Gore', 'explicit_genre' FROM docs WHERE mal_id % 19 = 0)"""


# -- for Spark ------------------------------------------------------------------------------
def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    # Customers and parts grow with the rest: their packed files say too little of what a broadcast would hold.
    customers = read(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return read(spark, folder, "orders").join(customers.hint("shuffle_hash"), "o_custkey")


def titles(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).selectExpr(*[f"{expr} AS {name}" for name, expr in TITLE.items()])


def _deal(rows: DataFrame, table: DataFrame, most: int, *by: str) -> DataFrame:
    tasks = -(-table.count() // most)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *by)


def dealt(rows: DataFrame, spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """The orders' rows dealt over tasks by their number: a task's rows become many times their size in it."""
    return _deal(rows, read(spark, folder, "orders"), TASK_ROWS, *by)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    # Several columns, so that rows without a key are dealt too.
    rows = dealt(orders(spark, folder), spark, folder, "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return rows.selectExpr(*[f"{expr} AS {name}" for name, expr in RAW.items()], "o_orderkey AS _seq")


def _part_tags() -> Column:
    made = [
        F.expr(f"CASE WHEN {w} THEN struct(CAST({i} AS BIGINT) AS genre_id, {n} AS name, '{k}' AS kind) END")
        for i, n, k, w in PART_TAGS
    ]
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    part, line = read(spark, folder, "part"), read(spark, folder, "lineitem")
    tagged = part.select("p_partkey", _part_tags().alias("t"))
    links = line.select(F.col("l_orderkey").alias("anime_id"), F.col("l_partkey").alias("p_partkey"))
    supplier = read(spark, folder, "supplier")

    def distinct(links: DataFrame) -> DataFrame:
        # Dealt by the number of lines: links pack so well that their size says little of what a task would hold of them.
        return _deal(links, line, TASK_LINES, *links.columns).distinct()

    tag_links = links.join(tagged.select("p_partkey", F.col("t.genre_id").alias("g")).hint("shuffle_hash"), "p_partkey")
    return {
        "titles": titles(spark, folder),
        "tags": part.select(F.inline(_part_tags())).distinct(),
        "title_tags": distinct(tag_links.select("anime_id", F.explode("g").alias("genre_id"))),
        "companies": supplier.selectExpr(
            "s_suppkey AS company_id", "CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey + 5000 END AS mal_id", "s_name AS name"
        ),
        "title_companies": distinct(line.selectExpr("l_orderkey AS anime_id", "l_suppkey AS company_id", f"{ROLE} AS role")),
    }


def docs(spark: SparkSession, folder: str) -> DataFrame:
    labelled = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id", "left")
    return labelled.selectExpr(*[f"{expr} AS {name}" for name, expr in DOC.items()], "lang", "source", "n_chars")


def doc_links(spark: SparkSession, folder: str) -> DataFrame:
    made = F.expr(
        """filter(array(
            CASE WHEN mal_id % 13 <> 0 THEN struct(lang AS tag, 'genre' AS kind) END,
            CASE WHEN mal_id % 7 <> 0 THEN struct(source AS tag, 'theme' AS kind) END,
            CASE WHEN n_chars > 3000 THEN struct('Long' AS tag, 'demographic' AS kind) END,
            CASE WHEN mal_id % 17 = 0 THEN struct('Award Winning' AS tag, 'genre' AS kind) END,
            CASE WHEN mal_id % 19 = 0 THEN struct('Gore' AS tag, 'explicit_genre' AS kind) END
        ), t -> t IS NOT NULL)"""
    )
    rows = read(spark, folder, "documents").selectExpr("doc_id AS mal_id", "lang", "source", "n_chars")
    return rows.select("mal_id", F.inline(made))
