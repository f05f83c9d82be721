"""Sources, cleaning, merging and the funnel, on messy text made from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import tables as X
from checks.registry import ORACLES, check, once
from titleworks.functions import cells as C
from titleworks.operators import cleaning as N
from titleworks.operators import merge as G
from titleworks.plans import funnel as U
from titleworks.plans import marts as M
from titleworks.plans.pipeline import Store, load, metadata, page_records, run
from titleworks.schemas import INTEGER_COLUMNS, NAMED, SNAPSHOT_COLUMNS
from titleworks.session import settle, working_path
from titleworks.sources import pages as P
from titleworks.sources.snapshot import read_snapshot
from titleworks.streaming.refresh import landed_pages, refresh

# -- the checking SQL's own cleaning ---------------------------------------------------------
EMPTY = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
CELLS_SQL = X.RAW_SQL + ",\ncells AS (SELECT " + ", ".join(
    f"CASE WHEN {c} NOT IN {EMPTY} THEN {c} END AS {c}" for c in SNAPSHOT_COLUMNS
) + ", seq FROM raw)"


def _text(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


def _int(c: str) -> str:
    return f"CAST(trunc(TRY_CAST({_text(c)} AS DOUBLE)) AS BIGINT)"


def _list(c: str) -> str:
    trimmed = rf"list_transform(string_split({c}, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
    return f"CASE WHEN {_text(c)} IS NULL OR lower({_text(c)}) = 'unknown' THEN [] ELSE list_filter({trimmed}, lambda x: x <> '') END"


def _companies(c: str) -> str:
    glue = "CASE WHEN x IN ('Inc.', 'Inc', 'Ltd.', 'Ltd', 'LLC', 'LLC.') THEN a || ', ' || x ELSE a || '|' || x END"
    return f"CASE WHEN len({_list(c)}) = 0 THEN [] ELSE string_split(list_reduce({_list(c)}, lambda a, x: {glue}), '|') END"


_PART = r"'([0-9]+)\s*(hr|min|sec)'"
_AMOUNTS, _UNITS = (f"regexp_extract_all(duration, {_PART}, {g})" for g in (1, 2))
DURATION = (
    f"(SELECT CASE WHEN s > 0 THEN greatest(1, CAST(round_even(s / 60.0, 0) AS BIGINT)) END FROM (SELECT list_sum(list_transform("
    f"range(1, len({_AMOUNTS}) + 1), lambda i: CAST(({_AMOUNTS})[i] AS BIGINT) * CASE ({_UNITS})[i] WHEN 'hr' THEN 3600 WHEN 'min' THEN 60 ELSE 1 END)) AS s))"
)
_DATE = r"'^(\d{4})-?(\d{2})-?(\d{2})(T.*)?$'"
AIRED = f"TRY_CAST(concat_ws('-', " + ", ".join(f"regexp_extract({_text('aired_from')}, {_DATE}, {g})" for g in (1, 2, 3)) + ") AS DATE)"
YEAR = f"coalesce({_int('year')}, CAST(year({AIRED}) AS BIGINT))"
_SEASON = f"lower({_text('season')})"
SEASON = f"CASE WHEN {_SEASON} IN ('winter', 'spring', 'summer', 'fall') THEN {_SEASON} ELSE ['winter', 'spring', 'summer', 'fall'][quarter({AIRED})] END"
CLEAN = {
    "mal_id": _int("mal_id"),
    **{c: _text(c) for c in ("title", "title_english", "type", "source")},
    "episodes": _int("episodes"),
    "duration_min": DURATION,
    "rating": _text("rating"),
    "synopsis": _text("synopsis"),
    "season": SEASON,
    "year": YEAR,
    **{c: _text(c) for c in ("broadcast_day", "broadcast_time", "status")},
    "score": f"TRY_CAST({_text('score')} AS DOUBLE)",
    **{c: _int(c) for c in ("scored_by", "members", "favorites")},
}
_TAGS = "list_concat(list_concat(" + _list("genres") + ", " + _list("explicit_genres") + "), list_concat(" + _list("themes") + ", " + _list("demographics") + "))"
RECORDS_SQL = CELLS_SQL + ",\nrecords AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CLEAN.items()) + f""", 'kaggle' AS data_source,
  {_TAGS} AS tags, {_companies('studios')} AS studios, {_companies('producers')} AS producers, {_companies('licensors')} AS licensors, seq FROM cells),
kept AS (SELECT * FROM records WHERE NOT starts_with(coalesce(rating, ''), 'Rx')),
prepared AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY mal_id ORDER BY seq DESC) = 1)"""  # fmt: skip
CREDITS = """credits AS (
  SELECT mal_id, seq, 'studio' AS role, unnest(studios) AS name FROM prepared
  UNION ALL SELECT mal_id, seq, 'producer', unnest(producers) FROM prepared
  UNION ALL SELECT mal_id, seq, 'licensor', unnest(licensors) FROM prepared)"""
SCALARS = [c for c in CLEAN if c != "score"] + ["data_source"]


# -- Spark side -------------------------------------------------------------------------------
def cells(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The messy rows with the reader's empty markers applied, without the detour over a file."""
    from titleworks.schemas import EMPTY_MARKERS

    rows = X.raw(spark, folder)
    return rows.select(*[F.when(~F.col(c).isin(*EMPTY_MARKERS), F.col(c)).alias(c) for c in SNAPSHOT_COLUMNS], "_seq")


def snapshot_file(spark, folder: str) -> str:  # noqa: ANN001
    """The messy rows written as CSV files, with two columns the reader must leave out."""

    def make() -> str:
        path = working_path(spark, "snapshot")
        rows = X.raw(spark, folder).withColumn("rank", F.lit(1)).withColumnRenamed("_seq", "popularity")
        for half, columns in enumerate((rows.columns, rows.columns[::-1])):  # two column orders
            rows.where(F.col("popularity") % 2 == half).select(*columns).write.mode("append").option("header", True).option("escape", '"').option(
                "quoteAll", True
            ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return path

    return once(spark, folder, "snapshot", make)


def records(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return N.clean_snapshot(cells(spark, folder), "kaggle", "_seq")


def prepared(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return once(spark, folder, "prepared", lambda: settle(N.prepare(records(spark, folder)), "prepared"))


def scalars(df: DataFrame) -> DataFrame:
    return df.select(*SCALARS, F.col("score").cast("double").alias("score"))


def listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.concat_ws("|", c) for c in columns})


check(
    "src_csv",
    lambda s, d: read_snapshot(s, snapshot_file(s, d)),
    f"WITH {CELLS_SQL} SELECT " + ", ".join(f"{_int(c)} AS {c}" if c in INTEGER_COLUMNS else c for c in SNAPSHOT_COLUMNS) + " FROM cells",
)
check(
    "clean_duration",
    lambda s, d: cells(s, d).select("_seq", "duration", C.duration_minutes(F.col("duration")).alias("minutes")),
    f"WITH {CELLS_SQL} SELECT seq AS _seq, duration, {DURATION} AS minutes FROM cells",
)
check(
    "clean_release_date",
    lambda s, d: cells(s, d).select(
        "_seq",
        C.release_year(F.col("year"), F.col("aired_from")).alias("year"),
        C.release_season(F.col("season"), F.col("aired_from")).alias("season"),
    ),
    f"WITH {CELLS_SQL} SELECT seq AS _seq, {YEAR} AS year, {SEASON} AS season FROM cells",
)
check(
    "clean_lists",
    lambda s, d: cells(s, d).select(
        "_seq",
        F.concat_ws("|", C.split_list(F.col("genres"))).alias("genres"),
        F.concat_ws("|", C.split_companies(F.col("producers"))).alias("producers"),
        F.concat_ws("|", C.split_companies(F.col("licensors"))).alias("licensors"),
    ),
    f"""WITH {CELLS_SQL} SELECT seq AS _seq, array_to_string({_list('genres')}, '|') AS genres,
    array_to_string({_companies('producers')}, '|') AS producers, array_to_string({_companies('licensors')}, '|') AS licensors FROM cells""",
)
check(
    "clean_catalog",
    lambda s, d: listed(records(s, d), "tags").select(
        *SCALARS, F.col("score").cast("double").alias("score"), "tags",
        F.concat_ws("|", F.transform("companies", lambda c: F.concat_ws("/", c["role"], c["name"]))).alias("companies"),
    ),
    f"""WITH {RECORDS_SQL} SELECT {', '.join(SCALARS)}, score, array_to_string(tags, '|') AS tags, array_to_string(list_concat(list_concat(
      list_transform(studios, lambda x: 'studio/' || x), list_transform(producers, lambda x: 'producer/' || x)),
      list_transform(licensors, lambda x: 'licensor/' || x)), '|') AS companies FROM records""",
)
check(
    "filter_excluded",
    lambda s, d: N.drop_excluded(records(s, d)).select("_seq", "mal_id", "rating"),
    f"WITH {RECORDS_SQL} SELECT seq AS _seq, mal_id, rating FROM kept",
)
check(
    "dedupe_last",
    lambda s, d: scalars(N.last_per_key(records(s, d), "mal_id", "_seq")),
    f"WITH {RECORDS_SQL} SELECT {', '.join(SCALARS)}, score FROM records QUALIFY row_number() OVER (PARTITION BY mal_id ORDER BY seq DESC) = 1",
)
check(
    "dedupe_last_event",
    lambda s, d: N.last_per_key(X.read(s, d, "events").select("user_id", "event_id", "event_type", "value", "props"), "user_id", "event_id"),
    "SELECT user_id, event_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
check(
    "prepare_counts",
    lambda s, d: N.prepare_counts(records(s, d)),
    f"""WITH {RECORDS_SQL} SELECT (SELECT count(*) FROM records) AS raw_rows,
    (SELECT count(*) FROM records) - (SELECT count(*) FROM kept) AS rx_dropped,
    (SELECT count(*) FROM kept) - (SELECT count(*) FROM prepared) AS duplicates_dropped, (SELECT count(*) FROM prepared) AS kept""",
)
check(
    "unreadable_cells",
    lambda s, d: N.unreadable_counts(cells(s, d).withColumn("episodes", F.concat("episodes", F.when(F.col("_seq") % 3 == 0, "?").otherwise("")))),
    f"WITH {CELLS_SQL}, t AS (SELECT * REPLACE (episodes || CASE WHEN seq % 3 = 0 THEN '?' ELSE '' END AS episodes) FROM cells) SELECT "
    + ", ".join(f"count(*) FILTER ({_text(c)} IS NOT NULL AND TRY_CAST({_text(c)} AS DOUBLE) IS NULL) AS {c}" for c in INTEGER_COLUMNS)
    + " FROM t",
)


# -- pages --------------------------------------------------------------------------------------
_ITEM = {
    "mal_id": "mal_id", "title": "title", "title_english": "title_english", "type": "type", "source": "source",
    "status": "status", "rating": "rating", "synopsis": "synopsis", "season": "season", "episodes": "episodes",
    "scored_by": "scored_by", "members": "members", "favorites": "favorites", "year": "year",
    "score": "CAST(score AS DOUBLE)", "duration": "CAST(duration_min AS STRING) || ' min per ep'",
}


def page_folder(spark, folder: str, gaps: bool = False) -> str:  # noqa: ANN001
    """Titles as landed JSON pages of 25, and an end; with gaps some pages are absent and some without data."""

    def make() -> str:
        path = working_path(spark, "pages")
        named = lambda *names: "array(" + ", ".join(f"named_struct('mal_id', {i}, 'name', {n})" for i, n in names) + ")"
        none = f"CAST(NULL AS {NAMED.upper()})"
        # Dealt by page before an order becomes an item many times its size, and packed: the pages alone are landed.
        orders = X.orders(spark, folder).withColumn("page", F.expr("CAST(o_orderkey DIV 25 AS INT) + 1"))
        t = X.dealt(orders, spark, folder, "page").selectExpr(*[f"{e} AS {n}" for n, e in X.TITLE.items()], "page").selectExpr(
            "mal_id AS id",
            "page",
            "named_struct("
            + ", ".join(f"'{n}', {e}" for n, e in _ITEM.items())
            + ", 'aired', CASE WHEN mal_id % 3 = 0 THEN named_struct('from', CAST(year AS STRING) || '-05-04T00:00:00+00:00') END"
            + ", 'broadcast', CASE WHEN mal_id % 3 = 0 THEN named_struct('day', broadcast_day, 'time', broadcast_time) END"
            + f", 'genres', {named(('1L', 'type'), ('mal_id', 'season'))}, 'explicit_genres', {none}, 'themes', {none}"
            + f", 'demographics', CASE WHEN mal_id % 2 = 0 THEN {named(('27L', chr(39) + 'Group1' + chr(39)))} END"
            + f", 'studios', {named(('mal_id % 40', chr(39) + 'Studio ' + chr(39) + ' || CAST(mal_id % 40 AS STRING)'))}"
            + f", 'producers', {none}, 'licensors', {named(('CAST(NULL AS BIGINT)', chr(39) + 'Pelmora' + chr(39)))}) AS item",
        )
        last = orders.agg(F.max("page")).first()[0]
        items = t.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", "item"))).alias("i"))
        absent, blank = ((F.lit(gaps) & (F.col("page") % n == k)) for n, k in ((41, 7), (53, 11)))
        landed = items.where(~absent).select(
            F.lit("top").alias("endpoint"),
            "page",
            F.when(~blank, F.col("i.item")).alias("data"),
            F.when(F.col("page") % 2 == 0, F.struct((F.col("page") < last).alias("has_next_page"))).alias("pagination"),
        )
        landed.write.partitionBy("endpoint").option("compression", "gzip").json(path)
        return path

    return once(spark, folder, f"pages-{gaps}", make)


def pages_asked(spark, folder: str) -> int:  # noqa: ANN001
    """As many pages as there are, and three more."""
    return X.read(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0] // 25 + 4


PAGES_SQL = X.TITLES_SQL + """, numbered AS (SELECT *, mal_id // 25 + 1 AS page FROM titles),
  ends AS (SELECT max(page) AS last FROM numbered),
  landed AS (SELECT * FROM numbered)"""


def with_gaps(sql: str) -> str:
    return sql.replace("landed AS (SELECT * FROM numbered)", "landed AS (SELECT * FROM numbered WHERE page % 41 <> 7 AND page % 53 <> 11)")


check(
    "src_pages",
    lambda s, d: P.page_items(P.read_pages(s, page_folder(s, d), P.TOP, pages_asked(s, d))).select(
        "page", "position", "item.mal_id", "item.title", "item.score", F.size("item.genres").alias("genres")
    ),
    f"""WITH {PAGES_SQL} SELECT CAST(page AS INTEGER) AS page, CAST(mal_id % 25 AS INTEGER) AS position, mal_id, title, CAST(score AS DOUBLE) AS score,
    CAST(2 AS INTEGER) AS genres FROM landed""",
)
check(
    "failed_pages",
    lambda s, d: P.failed_pages(s.read.schema(P.PAGE).json(f"{page_folder(s, d, True)}/endpoint=top"), pages_asked(s, d)),
    f"""WITH {with_gaps(PAGES_SQL)} SELECT CAST(page AS INTEGER) AS page FROM (SELECT unnest(range(1, CASE WHEN last % 2 = 0 AND last % 41 <> 7 AND last % 53 <> 11
    THEN last ELSE last + 3 END + 1)) AS page FROM ends) WHERE page NOT IN (SELECT page FROM landed)""",
)


def page_batch(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return page_records(P.read_pages(spark, page_folder(spark, folder), P.TOP, pages_asked(spark, folder)))


PAGE_RECORDS_SQL = PAGES_SQL + """, page_records AS (SELECT mal_id, title, title_english, type, source, episodes,
  duration_min, rating, synopsis, coalesce(season, CASE WHEN mal_id % 3 = 0 AND year IS NOT NULL THEN 'spring' END) AS season, year,
  CASE WHEN mal_id % 3 = 0 THEN broadcast_day END AS broadcast_day, CASE WHEN mal_id % 3 = 0 THEN broadcast_time END AS broadcast_time, status,
  CAST(score AS DOUBLE) AS score, scored_by, members, favorites, 'api' AS data_source FROM landed)"""
check(
    "flatten_pages",
    lambda s, d: page_batch(s, d).select(
        *SCALARS, F.col("score").cast("double").alias("score"), F.concat_ws("|", "tags").alias("tags"),
        F.concat_ws("|", F.transform("companies", lambda c: F.concat_ws("/", c["role"], c["name"], c["mal_id"]))).alias("companies"),
    ),
    f"""WITH {PAGE_RECORDS_SQL} SELECT {', '.join(SCALARS)}, score, concat_ws('|', type, season, CASE WHEN mal_id % 2 = 0 THEN 'Group1' END) AS tags,
    'studio/Studio ' || (mal_id % 40) || '/' || (mal_id % 40) || '|licensor/Pelmora' AS companies FROM page_records""",
)


# -- tags, companies, links ---------------------------------------------------------------------
def tag_rows(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return X.tables(spark, folder)["tags"]


def landed_families(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The tag table as the service gives it: one page per family."""
    families = {"genre": "genres", "explicit_genre": "explicit_genres", "theme": "themes", "demographic": "demographics"}
    family = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])[F.col("kind")]
    return (
        tag_rows(spark, folder)
        .groupBy(family.alias("family"))
        .agg(F.collect_list(F.struct(F.col("genre_id").alias("mal_id"), "name")).alias("data"))
    )


def _reference(spark, folder: str) -> DataFrame:  # noqa: ANN001
    path, out = working_path(spark, "families"), working_path(spark, "reference")
    landed_families(spark, folder).write.json(path)
    P.write_tag_reference(P.read_tag_families(spark, path), out)
    return P.read_tag_reference(spark, out)


check("src_tag_reference", _reference, f"WITH {X.TAGS_SQL} SELECT genre_id, name, kind FROM tags")


def old_tags(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """All tags under other names, and all again under other ids."""
    upper = tag_rows(spark, folder).withColumn("name", F.upper("name"))
    return upper.union(upper.withColumn("genre_id", F.col("genre_id") + 100_000))


check(
    "dim_tags",
    lambda s, d: G.merge_tags(old_tags(s, d), tag_rows(s, d)),
    f"WITH {X.TAGS_SQL} SELECT genre_id, name, kind FROM tags UNION ALL SELECT genre_id + 100000, upper(name), kind FROM tags",
)
MATCH_SQL = f"""{RECORDS_SQL}, {X.TAGS_SQL}, used AS (SELECT mal_id, unnest(tags) AS name, unnest(range(0, len(tags))) AS position FROM prepared),
matched AS (SELECT u.*, coalesce(t.genre_id, o.genre_id) AS genre_id FROM used u LEFT JOIN tags t USING (name)
  LEFT JOIN tags o ON o.name = CASE u.name WHEN 'Shoujo Ai' THEN 'Girls Love' WHEN 'Shounen Ai' THEN 'Boys Love' WHEN 'Cute Girls Doing Cute Things' THEN 'CGDCT' END)"""
check(
    "match_tags",
    lambda s, d: G.match_tags(prepared(s, d), tag_rows(s, d)),
    f"WITH {MATCH_SQL} SELECT mal_id, CAST(position AS INTEGER) AS position, name, genre_id FROM matched",
)
check(
    "match_tags_unmatched",
    lambda s, d: G.unmatched_tags(G.match_tags(prepared(s, d), tag_rows(s, d))),
    f"WITH {MATCH_SQL} SELECT name, count(*) AS titles FROM matched WHERE genre_id IS NULL GROUP BY name",
)


def _old_companies(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """Companies known from pages: "Studio n" has an id, and some are known under no id."""
    batch = G.batch_companies(page_batch(spark, folder))
    return G.merge_companies(None, batch)


check(
    "dim_companies",
    lambda s, d: G.merge_companies(_old_companies(s, d), G.batch_companies(prepared(s, d))).select("name", "mal_id"),
    f"""WITH {RECORDS_SQL}, {CREDITS}, {PAGES_SQL}, old AS (SELECT 'Studio ' || (mal_id % 40) AS name, mal_id % 40 AS mal_id FROM landed
      UNION SELECT 'Pelmora', NULL FROM landed)
    SELECT name, max(mal_id) AS mal_id FROM (SELECT name, mal_id FROM old UNION ALL SELECT name, NULL FROM credits) GROUP BY name""",
)


def _stored_links(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return X.tables(spark, folder)["title_tags"]


check(
    "replace_links",
    lambda s, d: G.replace_links(
        _stored_links(s, d),
        prepared(s, d).select(F.col("mal_id").alias("anime_id")),
        G.tag_links(G.match_tags(prepared(s, d), tag_rows(s, d))),
    ),
    f"""WITH {MATCH_SQL}, {X.LINKS_SQL} SELECT anime_id, genre_id FROM title_tags WHERE anime_id NOT IN (SELECT mal_id FROM prepared)
    UNION SELECT mal_id, genre_id FROM matched WHERE genre_id IS NOT NULL""",
)
check(
    "merge_upsert",
    lambda s, d: G.upsert_titles(X.titles(s, d), prepared(s, d), F.lit("2030-01-01").cast("timestamp")).select(
        *SCALARS, F.col("score").cast("double").alias("score"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated")
    ),
    f"""WITH {RECORDS_SQL}, {X.TITLES_SQL}
    SELECT {', '.join(SCALARS)}, score, '2030-01-01' AS updated FROM prepared
    UNION ALL SELECT {', '.join(SCALARS)}, CAST(score AS DOUBLE), strftime(updated_at, '%Y-%m-%d') FROM titles WHERE mal_id NOT IN (SELECT mal_id FROM prepared)""",
)
check(
    "merge_sources",
    lambda s, d: scalars(G.union_sources(prepared(s, d), N.prepare(page_batch(s, d)))),
    f"""WITH {RECORDS_SQL}, {PAGE_RECORDS_SQL}
    SELECT {', '.join(SCALARS)}, score FROM page_records
    UNION ALL SELECT {', '.join(SCALARS)}, score FROM prepared WHERE mal_id NOT IN (SELECT mal_id FROM page_records)""",
)


# -- funnel ---------------------------------------------------------------------------------------
FUNNEL_COLUMNS = ("mal_id", "status", "score", "members", "data_source")


def _loaded(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """What two loads leave, the snapshot's and the pages', of the titles that have lines: the columns that the funnel reads."""
    snapshot = prepared(spark, folder).select(*FUNNEL_COLUMNS, "_seq")
    pages = N.prepare(page_batch(spark, folder).select(*FUNNEL_COLUMNS, "rating", "_seq"))
    merged = G.union_sources(snapshot, pages.select(*FUNNEL_COLUMNS, "_seq"))
    sold = X.read(spark, folder, "lineitem").selectExpr("l_orderkey AS mal_id").distinct()
    return settle(merged.join(sold, "mal_id", "left_semi").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp")), "loaded")


def _funnel(spark, folder: str) -> tuple[DataFrame, int]:  # noqa: ANN001
    stored = _loaded(spark, folder)
    return U.build_funnel(U.source_counts(records(spark, folder), stored), M.filter_counts(stored))


LOADED_SQL = f"""{RECORDS_SQL}, {PAGE_RECORDS_SQL}, api AS (SELECT * FROM page_records),
stored AS (SELECT * FROM (SELECT mal_id, score, members, status, data_source FROM api UNION ALL SELECT mal_id, score, members, status, data_source FROM prepared
  WHERE mal_id NOT IN (SELECT mal_id FROM api)) WHERE mal_id IN (SELECT l_orderkey FROM lineitem))"""
check(
    "funnel",
    lambda s, d: _funnel(s, d)[0].select("label", "change", "rows"),
    f"""WITH {LOADED_SQL}, steps(step, label, change) AS (
      SELECT 0, 'Rows in the raw CSV', count(*) FROM records
      UNION ALL SELECT 1, 'Rx (adult) titles removed', (SELECT count(*) FROM kept) - (SELECT count(*) FROM records)
      UNION ALL SELECT 2, 'Duplicate rows removed', (SELECT count(*) FROM prepared) - (SELECT count(*) FROM kept)
      UNION ALL SELECT 3, 'CSV titles missing from the database', -count(*) FROM prepared WHERE mal_id NOT IN (SELECT mal_id FROM stored)
      UNION ALL SELECT 4, 'Titles added by the live API', count(*) FROM stored WHERE data_source = 'api' AND mal_id NOT IN (SELECT mal_id FROM prepared)
      UNION ALL SELECT 5, 'Database titles from an earlier load', count(*) FROM stored WHERE data_source <> 'api' AND mal_id NOT IN (SELECT mal_id FROM prepared)
      UNION ALL SELECT 6, 'No score', -count(*) FROM stored WHERE score IS NULL
      UNION ALL SELECT 7, 'Fewer than 1,000 members', -count(*) FROM stored WHERE score IS NOT NULL AND coalesce(members, 0) < 1000
      UNION ALL SELECT 8, 'Not yet aired', -count(*) FROM stored WHERE score IS NOT NULL AND members >= 1000 AND status = 'Not yet aired')
    SELECT label, CASE WHEN step > 0 THEN change END AS change, rows FROM (SELECT *, CAST(sum(change) OVER (ORDER BY step) AS BIGINT) AS rows FROM steps)
    WHERE step NOT IN (3, 5) OR change <> 0""",
)
check(
    "funnel_sources",
    lambda s, d: U.source_counts(records(s, d), _loaded(s, d)),
    f"""WITH {LOADED_SQL} SELECT (SELECT count(*) FROM records) AS raw_rows,
    (SELECT count(*) FROM records) - (SELECT count(*) FROM kept) AS rx_removed,
    (SELECT count(*) FROM kept) - (SELECT count(*) FROM prepared) AS duplicates_removed,
    (SELECT count(*) FROM prepared) AS kept_ids,
    (SELECT count(*) FROM prepared WHERE mal_id NOT IN (SELECT mal_id FROM stored)) AS missing,
    (SELECT count(*) FROM stored WHERE data_source = 'api' AND mal_id NOT IN (SELECT mal_id FROM prepared)) AS added,
    (SELECT count(*) FROM stored WHERE data_source <> 'api' AND mal_id NOT IN (SELECT mal_id FROM prepared)) AS earlier,
    (SELECT count(*) FROM stored WHERE data_source = 'api' AND mal_id IN (SELECT mal_id FROM prepared)) AS refreshed_by_api""",
)


# -- whole loads ----------------------------------------------------------------------------------
def loaded_state(spark, folder: str, times: int) -> dict[str, DataFrame]:  # noqa: ANN001
    state = None
    for _ in range(times):
        state, _lost = load(state, prepared(spark, folder), tag_rows(spark, folder))
        state = {name: settle(df, name) for name, df in state.items()}
    return state


STATE_SQL = f"""{MATCH_SQL}, {CREDITS}"""
COUNTS = [
    ("titles", "SELECT count(*) FROM prepared"),
    ("tags", "SELECT count(*) FROM tags"),
    ("title_tags", "SELECT count(DISTINCT (mal_id, genre_id)) FROM matched WHERE genre_id IS NOT NULL"),
    ("companies", "SELECT count(DISTINCT name) FROM credits"),
    ("title_companies", "SELECT count(DISTINCT (mal_id, name, role)) FROM credits"),
]
check(
    "load_idempotent",
    lambda s, d: G.table_counts(loaded_state(s, d, 2)),
    f"WITH {STATE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, ({q}) AS rows" for n, q in COUNTS),
)


def _run(spark, folder: str, gaps: bool = False) -> Store:  # noqa: ANN001
    def make() -> Store:
        store = Store(spark, working_path(spark, "store"))
        reference = settle(tag_rows(spark, folder), "tags")
        run(store, reference, snapshot_file(spark, folder), page_folder(spark, folder, gaps), pages_asked(spark, folder))
        return store

    return once(spark, folder, f"store-{gaps}", make)


check(
    "pipeline_titles",
    lambda s, d: scalars(_run(s, d).current()["titles"]),
    f"""WITH {RECORDS_SQL}, {PAGE_RECORDS_SQL}
    SELECT {', '.join(SCALARS)}, score FROM page_records
    UNION ALL SELECT {', '.join(SCALARS)}, score FROM prepared WHERE mal_id NOT IN (SELECT mal_id FROM page_records)""",
)
check(
    "run_log",
    lambda s, d: _run(s, d, True).runs().select("base_source", "api_pages_requested", "api_pages_failed", "anime_upserted", "status", "message"),
    f"""WITH {MATCH_SQL}, {with_gaps(PAGE_RECORDS_SQL)}, page_tags AS (SELECT unnest(CASE WHEN mal_id % 2 = 0 THEN [type, season, 'Group1'] ELSE [type, season] END) AS name FROM page_records),
    lost AS (SELECT (SELECT count(*) FROM matched WHERE genre_id IS NULL) + (SELECT count(*) FROM page_tags WHERE name IS NULL OR name NOT IN (SELECT name FROM tags)) AS n),
    asked AS (SELECT CASE WHEN last % 2 = 0 AND last % 41 <> 7 AND last % 53 <> 11 THEN last ELSE last + 3 END AS pages, last + 3 AS requested FROM ends),
    failed AS (SELECT count(*) AS n FROM (SELECT unnest(range(1, pages + 1)) AS page FROM asked) WHERE page NOT IN (SELECT page FROM landed))
    SELECT 'csv' AS base_source, requested AS api_pages_requested, failed.n AS api_pages_failed,
      (SELECT count(*) FROM prepared) + (SELECT count(*) FROM page_records) AS anime_upserted,
      CASE WHEN failed.n > 0 THEN 'partial' ELSE 'success' END AS status,
      'rx_dropped=' || ((SELECT count(*) FROM records) - (SELECT count(*) FROM kept)) || ' duplicates_dropped=' ||
      ((SELECT count(*) FROM kept) - (SELECT count(*) FROM prepared)) || ' unmatched_tags=' || lost.n AS message
    FROM lost, asked, failed""",
)
check(
    "run_metadata",
    lambda s, d: metadata(X.tables(s, d)).select(
        F.date_format("data_last_updated", "yyyy-MM-dd").alias("data_last_updated"),
        "analysis_population",
        *[F.element_at("data_source_counts", n).alias(n) for n in ("kaggle", "api")],
        *[F.element_at("row_counts", n).alias(n) for n, _ in COUNTS],
    ),
    f"""WITH {X.BASE_SQL} SELECT strftime(max(updated_at), '%Y-%m-%d') AS data_last_updated, (SELECT count(*) FROM population) AS analysis_population,
    count(*) FILTER (data_source = 'kaggle') AS kaggle, count(*) FILTER (data_source = 'api') AS api, """
    + ", ".join(f"(SELECT count(*) FROM {n}) AS {n}" for n, _ in COUNTS)
    + " FROM titles",
)


def _refreshed(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The snapshot's tables, then all landed pages taken in as a stream."""
    store = Store(spark, working_path(spark, "refreshed"))
    reference = settle(tag_rows(spark, folder), "tags")
    run(store, reference, snapshot_file(spark, folder))
    pages = landed_pages(spark, f"{page_folder(spark, folder)}/endpoint=top")
    refresh(pages, store, reference, working_path(spark, "stream")).awaitTermination()
    return scalars(store.current()["titles"])


check("refresh_stream", _refreshed, ORACLES["pipeline_titles"])
