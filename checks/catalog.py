"""Catalog tables and the four questions' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import tables as X
from checks.registry import check
from titleworks.operators.merge import quality_rules, table_counts
from titleworks.plans import analysis as A
from titleworks.plans import marts as M

FACTORS_SQL = """
studio_counts AS (
  SELECT c.company_id, c.name, row_number() OVER (ORDER BY count(*) DESC, c.name) AS studio_rank
  FROM title_companies tc JOIN population p ON p.mal_id = tc.anime_id JOIN companies c USING (company_id)
  WHERE tc.role = 'studio' GROUP BY c.company_id, c.name),
main_studio AS (
  SELECT DISTINCT ON (tc.anime_id) tc.anime_id, s.name, s.studio_rank
  FROM title_companies tc JOIN studio_counts s USING (company_id)
  WHERE tc.role = 'studio' ORDER BY tc.anime_id, s.studio_rank),
demographic AS (
  SELECT anime_id, CASE WHEN count(*) > 1 THEN 'Multiple' ELSE min(name) END AS demographic
  FROM title_tags JOIN tags USING (genre_id) WHERE kind = 'demographic' GROUP BY anime_id),
factors AS (
  SELECT p.mal_id, CAST(p.score AS DOUBLE) AS score, coalesce(p.type, 'Unknown') AS type, coalesce(p.source, 'Unknown') AS source,
    p.episodes, p.duration_min, coalesce(p.rating, 'Unknown') AS rating, coalesce(p.season, 'Unknown') AS season, p.year,
    coalesce(d.demographic, 'None') AS demographic,
    CASE WHEN m.anime_id IS NULL THEN 'Unknown' WHEN m.studio_rank <= 15 THEN m.name ELSE 'Other' END AS studio_group
  FROM population p LEFT JOIN main_studio m ON m.anime_id = p.mal_id LEFT JOIN demographic d ON d.anime_id = p.mal_id)"""
QUESTION_TAGS_SQL = """
question_tags AS (
  SELECT l.anime_id AS mal_id, g.name AS tag, g.kind FROM title_tags l JOIN tags g USING (genre_id)
  JOIN population p ON p.mal_id = l.anime_id WHERE g.kind IN ('genre', 'theme')),
tag_counts AS (
  SELECT kind, tag, count(*) AS titles, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, tag) AS place
  FROM question_tags WHERE tag <> 'Award Winning' GROUP BY kind, tag),
chosen AS (SELECT *, kind || '=' || tag AS factor FROM tag_counts WHERE place <= CASE kind WHEN 'genre' THEN 15 ELSE 10 END)"""
BASE = f"WITH {X.BASE_SQL}"


def population(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return M.population(X.titles(spark, folder))


def factors(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return M.fill_unknown(M.factor_frame(X.titles(spark, folder), X.tables(spark, folder)))


def question_tags(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return M.question_tags(population(spark, folder), X.tables(spark, folder))


check(
    "by_year",
    lambda s, d: M.by_year(X.titles(s, d)).withColumn("mean_score", F.round("mean_score", 6)).orderBy("year"),
    f"""WITH {X.TITLES_SQL}, {X.POPULATION_SQL}
    SELECT a.year, count(*) AS titles_in_catalog, count(p.mal_id) AS titles_in_population,
      quantile_cont(CAST(p.score AS DOUBLE), 0.5) AS median_score, round(avg(CAST(p.score AS DOUBLE)), 6) AS mean_score
    FROM titles a LEFT JOIN population p USING (mal_id) WHERE a.year IS NOT NULL GROUP BY a.year""",
)
check(
    "population",
    lambda s, d: population(s, d).select("mal_id", F.col("score").cast("double"), "members", "status"),
    f"WITH {X.TITLES_SQL}, {X.POPULATION_SQL} SELECT mal_id, CAST(score AS DOUBLE) AS score, members, status FROM population",
)
check(
    "funnel_counts",
    lambda s, d: M.filter_counts(X.titles(s, d)),
    f"""WITH {X.TITLES_SQL} SELECT count(*) AS in_database, count(*) FILTER (score IS NOT NULL) AS has_score,
      count(*) FILTER (score IS NOT NULL AND members >= 1000) AS enough_members,
      count(*) FILTER (score IS NOT NULL AND members >= 1000 AND status IS DISTINCT FROM 'Not yet aired') AS has_aired FROM titles""",
)
check(
    "top250",
    lambda s, d: M.top_scores(population(s, d)),
    f"""WITH {X.TITLES_SQL}, {X.POPULATION_SQL} SELECT mal_id, CAST(score AS DOUBLE) AS score, score_rank FROM
      (SELECT *, rank() OVER (ORDER BY score DESC) AS score_rank FROM population) WHERE score_rank <= 250""",
)
check(
    "member_deciles",
    lambda s, d: M.member_deciles(population(s, d)),
    f"""WITH {X.TITLES_SQL}, {X.POPULATION_SQL} SELECT mal_id, CAST(score AS DOUBLE) AS score, members,
      ntile(10) OVER (ORDER BY members, mal_id) AS members_decile FROM population""",
)
check(
    "popularity_deciles",
    lambda s, d: A.popularity_deciles(M.member_deciles(population(s, d))).select("decile", "n", "median", "members_min", "members_max"),
    f"""WITH {X.TITLES_SQL}, {X.POPULATION_SQL}, t AS (SELECT *, ntile(10) OVER (ORDER BY members, mal_id) AS decile FROM population)
    SELECT decile, count(*) AS n, quantile_cont(CAST(score AS DOUBLE), 0.5) AS median, min(members) AS members_min, max(members) AS members_max
    FROM t GROUP BY decile""",
)
check(
    "catalog",
    lambda s, d: M.catalog(X.titles(s, d), X.tables(s, d)).withColumns({c: F.concat_ws("|", c) for c in ("genres", "studios")}),
    f"""{BASE} SELECT mal_id, title, title_english, type, year, CAST(score AS DOUBLE) AS score, members,
      coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM title_tags JOIN tags USING (genre_id) WHERE anime_id = t.mal_id), '') AS genres,
      coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM title_companies JOIN companies c USING (company_id)
        WHERE anime_id = t.mal_id AND role = 'studio'), '') AS studios FROM titles t""",
)
check(
    "tag_links",
    question_tags,
    f"{BASE}, {QUESTION_TAGS_SQL} SELECT mal_id, tag, kind FROM question_tags",
)
check(
    "main_studio",
    lambda s, d: (lambda t, p: (lambda k: M.main_studio(k, M.studio_ranks(k, t["companies"])))(M.studio_links(p, t)))(
        X.tables(s, d), population(s, d)
    ).select("mal_id", "name"),
    f"""{BASE}, {FACTORS_SQL} SELECT m.anime_id AS mal_id, m.name FROM main_studio m JOIN population p ON p.mal_id = m.anime_id""",
)
check("factor_frame", factors, f"{BASE}, {FACTORS_SQL} SELECT * FROM factors")
check(
    "common_tags",
    lambda s, d: M.common_tags(question_tags(s, d)).select("kind", "tag", "titles", F.col("place").cast("bigint").alias("place"), "factor"),
    f"{BASE}, {QUESTION_TAGS_SQL} SELECT kind, tag, titles, place, factor FROM chosen",
)


def _indicators(spark, folder: str) -> DataFrame:  # noqa: ANN001
    tags = question_tags(spark, folder)
    return A.tag_indicators(tags, A.chosen_tags(tags))


check(
    "tag_indicators",
    _indicators,
    f"{BASE}, {QUESTION_TAGS_SQL} SELECT DISTINCT mal_id, factor FROM question_tags JOIN chosen USING (kind, tag)",
)
check(
    "decades",
    lambda s, d: M.decades(M.by_year(X.titles(s, d)), population(s, d).select("year", F.col("score").cast("double"))),
    f"""WITH {X.TITLES_SQL}, {X.POPULATION_SQL} SELECT CAST(floor(a.year / 10) * 10 AS BIGINT) AS decade, count(*) AS titles_in_catalog,
      count(p.mal_id) AS titles_in_population, quantile_cont(CAST(p.score AS DOUBLE), 0.5) AS median_score
    FROM titles a LEFT JOIN population p USING (mal_id) WHERE a.year IS NOT NULL GROUP BY 1""",
)
check(
    "table_counts",
    lambda s, d: table_counts(X.tables(s, d)),
    f"{BASE} "
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("titles", "tags", "title_tags", "companies", "title_companies")),
)


def _broken(spark, folder: str) -> dict[str, DataFrame]:  # noqa: ANN001
    """The tables with a repeated title per customer, a stray role, and links to titles that are gone."""
    t = X.tables(spark, folder)
    return {
        **t,
        "titles": t["titles"].where("data_source <> 'api'").unionByName(t["titles"].where("rating is null").withColumn("season", F.lit("monsoon"))),
        "companies": t["companies"].withColumn("mal_id", F.expr("mal_id % 40")),
        "title_companies": t["title_companies"].withColumn("role", F.expr("CASE WHEN company_id % 10 = 3 THEN 'sponsor' ELSE role END")),
    }


check(
    "dq_rules",
    lambda s, d: quality_rules(_broken(s, d)),
    f"""{BASE}, t AS (SELECT * FROM titles WHERE data_source <> 'api' UNION ALL SELECT * REPLACE ('monsoon' AS season) FROM titles WHERE rating IS NULL),
    c AS (SELECT * REPLACE (mal_id % 40 AS mal_id) FROM companies),
    l AS (SELECT * REPLACE (CASE WHEN company_id % 10 = 3 THEN 'sponsor' ELSE role END AS role) FROM title_companies)
    SELECT 'title season' AS rule, count(*) AS violations FROM t WHERE season NOT IN ('winter', 'spring', 'summer', 'fall')
    UNION ALL SELECT 'title data source', count(*) FROM t WHERE data_source NOT IN ('kaggle', 'api')
    UNION ALL SELECT 'tag kind', count(*) FROM tags WHERE kind NOT IN ('genre', 'explicit_genre', 'theme', 'demographic')
    UNION ALL SELECT 'company role', count(*) FROM l WHERE role NOT IN ('studio', 'producer', 'licensor')
    UNION ALL SELECT 'title id', count(*) - count(DISTINCT mal_id) FROM t
    UNION ALL SELECT 'tag name', count(*) - count(DISTINCT name) FROM tags
    UNION ALL SELECT 'company name', count(*) - count(DISTINCT name) FROM c
    UNION ALL SELECT 'company source id', count(mal_id) - count(DISTINCT mal_id) FROM c
    UNION ALL SELECT 'tag link', count(*) - count(DISTINCT (anime_id, genre_id)) FROM title_tags
    UNION ALL SELECT 'company link', count(*) - count(DISTINCT (anime_id, company_id, role)) FROM l
    UNION ALL SELECT 'tag link title', count(*) FROM title_tags WHERE anime_id NOT IN (SELECT mal_id FROM t)
    UNION ALL SELECT 'tag link tag', count(*) FROM title_tags WHERE genre_id NOT IN (SELECT genre_id FROM tags)
    UNION ALL SELECT 'company link title', count(*) FROM l WHERE anime_id NOT IN (SELECT mal_id FROM t)
    UNION ALL SELECT 'company link company', count(*) FROM l WHERE company_id NOT IN (SELECT company_id FROM c)""",
)
