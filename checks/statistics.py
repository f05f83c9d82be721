"""Rank statistics, the regression, and the report tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import tables as X
from checks.catalog import BASE, FACTORS_SQL, QUESTION_TAGS_SQL, factors, population, question_tags
from checks.cleaning import _funnel
from checks.registry import check, once
from titleworks.operators import rank_tests as R
from titleworks.operators.ranks import average_ranks
from titleworks.operators.regression import design, fit, level_counts, nonzero_entries, reference_levels
from titleworks.plans import analysis as A
from titleworks.plans import marts as M
from titleworks.plans import outputs as O
from titleworks.plans import report as P
from titleworks.session import settle, unbounded, working_path
from titleworks.sources import sinks as S

CATEGORIES = list(M.CATEGORICAL_FACTORS)
CATEGORY_SQL = "category_rows AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS factor, {c} AS grp, score FROM factors" for c in CATEGORIES
) + ")"
TAG_ROWS_SQL = """have AS (SELECT DISTINCT mal_id, factor FROM question_tags JOIN chosen USING (kind, tag)),
tag_rows AS (SELECT c.factor, CASE WHEN h.mal_id IS NULL THEN 'false' ELSE 'true' END AS grp, f.score, f.mal_id
  FROM factors f CROSS JOIN chosen c LEFT JOIN have h ON h.mal_id = f.mal_id AND h.factor = c.factor),
top_ids AS (SELECT mal_id FROM (SELECT mal_id, rank() OVER (ORDER BY score DESC) AS r FROM population) WHERE r <= 250),
top_rows AS (SELECT * FROM tag_rows SEMI JOIN top_ids USING (mal_id))"""
ALL_SQL = f"{BASE}, {FACTORS_SQL}, {CATEGORY_SQL}, {QUESTION_TAGS_SQL}, {TAG_ROWS_SQL}"


def kruskal_sql(rows: str) -> str:
    """The textbook form: H from rank sums, divided by the tie correction."""
    return f"""SELECT factor, n, round(h / ties, 6) AS statistic, round(h / ties / (n - 1), 9) AS effect_size FROM (
      SELECT factor, n, 12.0 / (CAST(n AS DOUBLE) * (n + 1)) * sum(r * r / size) - 3.0 * (n + 1) AS h, any_value(ties) AS ties FROM (
        SELECT factor, grp, n, any_value(ties) AS ties, sum(rk) AS r, count(*) AS size FROM (
          SELECT *, 1 - sum((CAST(t AS DOUBLE) * t * t - t) / t) OVER (PARTITION BY factor) / (CAST(n AS DOUBLE) * n * n - n) AS ties FROM (
            SELECT factor, grp, rank() OVER (PARTITION BY factor ORDER BY score) + (count(*) OVER (PARTITION BY factor, score) - 1) / 2.0 AS rk,
              count(*) OVER (PARTITION BY factor, score) AS t, count(*) OVER (PARTITION BY factor) AS n FROM {rows}))
        GROUP BY factor, grp, n)
      GROUP BY factor, n HAVING count(*) > 1)"""


def rho_sql(x: str, rows: str) -> str:
    return f"""SELECT '{x}' AS factor, count(*) AS n, round(corr(rx, ry), 9) AS statistic, round(corr(rx, ry) ** 2, 9) AS effect_size FROM (
      SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ry FROM {rows} WHERE {x} IS NOT NULL)"""


def analysis(spark, folder: str) -> dict[str, DataFrame]:  # noqa: ANN001
    """All result tables of one analysis run."""

    def make() -> A.Results:
        return A.analyze(X.titles(spark, folder), X.tables(spark, folder))

    return once(spark, folder, "analysis", make)


def kept_factors(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return once(spark, folder, "factors", lambda: settle(factors(spark, folder), "factors"))


def kept_tags(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return once(spark, folder, "tags", lambda: settle(question_tags(spark, folder), "tags"))


def tag_cells(spark, folder: str, top: bool = False) -> DataFrame:  # noqa: ANN001
    rows = kept_factors(spark, folder).select("mal_id", "score")
    if top:
        rows = rows.join(unbounded(M.top_scores(population(spark, folder)).select("mal_id")), "mal_id", "left_semi")
    chosen = A.chosen_tags(kept_tags(spark, folder))
    links = A.tag_indicators(kept_tags(spark, folder), chosen).join(unbounded(rows), "mal_id")
    return R.tag_cells(links, A.score_counts(rows), chosen)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def member_pairs(spark, folder: str) -> DataFrame:  # noqa: ANN001
    pop = population(spark, folder).select(F.col("score").cast("double").alias("score"), "members")
    return R.pair_cells(kept_factors(spark, folder), list(M.NUMERIC_FACTORS)).unionByName(R.pair_cells(pop, ["members"]))


check(
    "avg_rank",
    lambda s, d: average_ranks(
        population(s, d).groupBy("members").agg(F.count("*").alias("n")), "members", "n", bounded=False
    ),
    f"""WITH {X.TITLES_SQL}, {X.POPULATION_SQL} SELECT members, n, sum(n) OVER (ORDER BY members) - n + (n + 1) / 2.0 AS avg_rank
    FROM (SELECT members, count(*) AS n FROM population GROUP BY members)""",
)
check(
    "spearman",
    lambda s, d: rounded(R.spearman(member_pairs(s, d)), statistic=9, effect_size=9),
    f"{BASE}, {FACTORS_SQL} "
    + " UNION ALL ".join([rho_sql(c, "factors") for c in M.NUMERIC_FACTORS] + [rho_sql("members", "population")]),
)
check(
    "kruskal",
    lambda s, d: rounded(R.kruskal(R.category_cells(kept_factors(s, d), CATEGORIES)), statistic=6, effect_size=9).drop("groups"),
    f"{BASE}, {FACTORS_SQL}, {CATEGORY_SQL} {kruskal_sql('category_rows')}",
)
check(
    "kruskal_tags",
    lambda s, d: rounded(R.kruskal(tag_cells(s, d)), statistic=6, effect_size=9).drop("groups"),
    f"{ALL_SQL} {kruskal_sql('tag_rows')}",
)
check(
    "group_medians",
    lambda s, d: R.group_medians(R.category_cells(kept_factors(s, d), CATEGORIES)).select("factor", "group", "n", "median"),
    f"{BASE}, {FACTORS_SQL}, {CATEGORY_SQL} SELECT factor, grp AS \"group\", count(*) AS n, quantile_cont(score, 0.5) AS median FROM category_rows GROUP BY ALL",
)
# A limit is the value at the first rank k at which a binomial(n, k / n) count reaches the middle rank with the share's probability.
INTERVAL_SQL = """sizes AS (SELECT factor, grp, count(*) AS n, quantile_cont(score, 0.5) AS median FROM category_rows GROUP BY ALL),
asked AS (SELECT DISTINCT n, middle, share FROM (SELECT n, unnest([(n + 1) // 2, n // 2 + 1]) AS middle FROM sizes), (SELECT unnest([0.025, 0.975]) AS share)),
near AS (SELECT *, CAST(middle + CASE WHEN share < 0.5 THEN -1 ELSE 1 END * 0.98 * sqrt(n) AS BIGINT) AS about FROM asked),
tries AS (SELECT n, middle, share, unnest(range(greatest(1, about - 25), least(n, about + 25) + 1)) AS k FROM near),
tails AS (SELECT n, middle, share, k, CASE WHEN k = n THEN 1.0 ELSE list_sum(list_transform(range(middle, n + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n)))) END AS tail FROM tries),
ranks AS (SELECT n, middle, share, min(k) AS rank FROM tails WHERE tail >= share GROUP BY ALL),
placed AS (SELECT factor, grp, score, row_number() OVER (PARTITION BY factor, grp ORDER BY score) AS place FROM category_rows)"""
check(
    "median_ci",
    lambda s, d: R.group_medians(R.category_cells(kept_factors(s, d), CATEGORIES)),
    f"""{BASE}, {FACTORS_SQL}, {CATEGORY_SQL}, {INTERVAL_SQL}
    SELECT factor, grp AS "group", n, any_value(median) AS median, avg(score) FILTER (share < 0.5) AS ci_low, avg(score) FILTER (share > 0.5) AS ci_high
    FROM sizes JOIN ranks USING (n) JOIN placed USING (factor, grp) WHERE place = rank GROUP BY factor, grp, n""",
)
check(
    "tag_effects",
    lambda s, d: A.tag_effects(tag_cells(s, d)).select(
        "factor", "kind", "tag", "n_with", "median_with", "n_without", "median_without", F.round("difference", 6).alias("difference")
    ),
    f"""{ALL_SQL} SELECT factor, split_part(factor, '=', 1) AS kind, substring(factor, strpos(factor, '=') + 1) AS tag,
    count(*) FILTER (grp = 'true') AS n_with, quantile_cont(score, 0.5) FILTER (grp = 'true') AS median_with,
    count(*) FILTER (grp = 'false') AS n_without, quantile_cont(score, 0.5) FILTER (grp = 'false') AS median_without,
    round(quantile_cont(score, 0.5) FILTER (grp = 'true') - quantile_cont(score, 0.5) FILTER (grp = 'false'), 6) AS difference
    FROM tag_rows GROUP BY factor""",
)
RANGE_SQL = """ranges AS (SELECT e.factor, share_population, share_top250, n_with_top250, difference_top250 FROM
  (SELECT factor, avg(CAST(grp = 'true' AS INTEGER)) AS share_population FROM tag_rows GROUP BY factor) e LEFT JOIN
  (SELECT factor, avg(CAST(grp = 'true' AS INTEGER)) AS share_top250, count(*) FILTER (grp = 'true') AS n_with_top250,
    quantile_cont(score, 0.5) FILTER (grp = 'true') - quantile_cont(score, 0.5) FILTER (grp = 'false') AS difference_top250
   FROM top_rows GROUP BY factor) t USING (factor))"""
check(
    "range_restriction",
    lambda s, d: rounded(
        A.range_restriction(tag_cells(s, d), tag_cells(s, d, top=True)), share_population=9, share_top250=9, difference_top250=6
    ),
    f"""{ALL_SQL}, {RANGE_SQL} SELECT factor, round(share_population, 9) AS share_population, round(share_top250, 9) AS share_top250,
    n_with_top250, round(difference_top250, 6) AS difference_top250 FROM ranges""",
)


def _bin_sql(factor: str) -> str:
    bins = M.BIN_EDGES[factor]
    label = " ".join(f"WHEN {factor} <= {edge} THEN '{name}'" for edge, name in bins[:-1])
    order = " ".join(f"WHEN '{name}' THEN {i}" for i, (_, name) in enumerate(bins))
    return f"""SELECT factor, "group", CAST(CASE "group" {order} END AS BIGINT) AS "order", n, median FROM (
      SELECT '{factor}' AS factor, CASE {label} ELSE '{bins[-1][1]}' END AS "group", count(*) AS n, quantile_cont(score, 0.5) AS median
      FROM factors WHERE {factor} > 0 GROUP BY ALL)"""


check(
    "numeric_bins",
    lambda s, d: A.numeric_bins(kept_factors(s, d)).select("factor", "group", "order", "n", "median"),
    f"{BASE}, {FACTORS_SQL} " + " UNION ALL ".join(_bin_sql(f) for f in M.BIN_EDGES),
)


def _p_rows(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """A column of shares between 0 and 1, one per brand and line status, to adjust as p-values."""
    line = X.read(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linestatus", "l_discount")
    part = X.read(spark, folder, "part").select("p_partkey", "p_brand")
    low = F.count_if(F.col("l_discount") < 0.045) / F.count("*")
    return line.join(part, "p_partkey").groupBy(F.concat_ws("/", "p_brand", "l_linestatus").alias("factor")).agg(
        (low * low * low).alias("p_value")
    )


check(
    "bh_adjust",
    lambda s, d: rounded(R.adjust_p_values(_p_rows(s, d)), p_value=9, p_adjusted=9),
    """WITH p AS (SELECT p_brand || '/' || l_linestatus AS factor, (count(*) FILTER (l_discount < 0.045) / count(*)) ** 3 AS p_value
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY p_value, factor) AS k, count(*) OVER () AS m FROM p)
    SELECT factor, round(p_value, 9) AS p_value, round(least(1, min(p_value * m / k) OVER (ORDER BY k DESC)), 9) AS p_adjusted FROM r""",
)
LEVELS_SQL = "levels AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS factor, {c} AS level, count(*) AS n FROM factors GROUP BY {c}" for c in CATEGORIES
) + "), refs AS (SELECT factor, level AS reference FROM levels QUALIFY row_number() OVER (PARTITION BY factor ORDER BY n DESC, level) = 1)"
check(
    "design_reference",
    lambda s, d: reference_levels(level_counts(kept_factors(s, d), CATEGORIES)),
    f"{BASE}, {FACTORS_SQL}, {LEVELS_SQL} SELECT factor, reference FROM refs",
)


def _design(spark, folder: str) -> DataFrame:  # noqa: ANN001
    tags = kept_tags(spark, folder)
    chosen = A.chosen_tags(tags)
    df = A.model_frame(kept_factors(spark, folder), A.tag_indicators(tags, chosen))
    flags = {f: F.array_contains("tag_set", f) for f in chosen}
    made = design(df, A.numeric_terms(), CATEGORIES, flags)
    return nonzero_entries(df, "mal_id", made).withColumn("value", F.round("value", 9))


_COMPLETE = "complete AS (SELECT * FROM factors WHERE episodes IS NOT NULL AND duration_min IS NOT NULL AND year IS NOT NULL)"
check(
    "design_matrix",
    _design,
    f"""{ALL_SQL}, {_COMPLETE}, {LEVELS_SQL.replace("FROM factors", "FROM complete")}
    SELECT mal_id, 'log1p(episodes)' AS term, round(ln(1 + episodes), 9) AS value FROM complete
    UNION ALL SELECT mal_id, 'log1p(duration_min)', round(ln(1 + duration_min), 9) FROM complete
    UNION ALL SELECT mal_id, 'year', CAST(year AS DOUBLE) FROM complete
    UNION ALL SELECT mal_id, factor, 1.0 FROM have SEMI JOIN complete USING (mal_id) """
    + " ".join(
        f"UNION ALL SELECT mal_id, '{c}=' || {c}, 1.0 FROM complete WHERE {c} <> (SELECT reference FROM refs WHERE factor = '{c}')" for c in CATEGORIES
    ),
)
check("ols_fit", lambda s, d: analysis(s, d).tables["ols_coefficients"])


def _fit_facts(spark, folder: str) -> DataFrame:  # noqa: ANN001
    facts = analysis(spark, folder).model_fit
    return spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "fact string, value double")


check("cv_r2", _fit_facts)


def _one_factor(spark, folder: str) -> tuple:  # noqa: ANN001
    df = kept_factors(spark, folder)
    return fit(df, "mal_id", "score", design(df, {}, ["season"], {}))


# With one category the fit is the groups' means, a row's leverage 1 / n of its group, and the robust
# error of a mean sqrt(sum e^2 / (1 - 1 / n)^2) / n.
GROUPS_SQL = """groups AS (SELECT season AS g, count(*) AS n, avg(score) AS mean FROM factors GROUP BY season),
spread AS (SELECT g, any_value(n) AS n, any_value(mean) AS mean, sum(((score - mean) / (1 - 1.0 / n)) ** 2) / any_value(n) ** 2 AS var
  FROM factors JOIN groups ON season = g GROUP BY g),
base AS (SELECT * FROM spread ORDER BY n DESC, g LIMIT 1)"""
FOLD_SQL = "CAST(mal_id % 2147483648 * 2654435761 % 4294967296 % 5 AS INTEGER)"
check(
    "ols_one_factor",
    lambda s, d: rounded(s.createDataFrame(_one_factor(s, d)[0]), coef=9, std_err=9, ci_low=9, ci_high=9).drop("p_value"),
    f"""{BASE}, {FACTORS_SQL}, {GROUPS_SQL}, terms AS (SELECT 'const' AS term, mean AS coef, sqrt(var) AS std_err FROM base
      UNION ALL SELECT 'season=' || s.g, s.mean - b.mean, sqrt(s.var + b.var) FROM spread s, base b WHERE s.g <> b.g)
    SELECT term, round(coef, 9) AS coef, round(std_err, 9) AS std_err, round(coef - 1.959963984540054 * std_err, 9) AS ci_low,
      round(coef + 1.959963984540054 * std_err, 9) AS ci_high FROM terms""",
)
check(
    "cv_one_factor",
    lambda s, d: rounded(s.createDataFrame([tuple(map(float, _one_factor(s, d)[1].values()))], ", ".join(f"{k} double" for k in ("n", "r2", "adj_r2", "model_r2", "model_r2_std", "baseline_r2"))),
                         r2=9, adj_r2=9, model_r2=9, model_r2_std=9, baseline_r2=9),
    f"""{BASE}, {FACTORS_SQL}, rows AS (SELECT season AS g, CAST(score AS DOUBLE) AS y, {FOLD_SQL} AS fold FROM factors),
    cells AS (SELECT fold, g, count(*) AS n, sum(y) AS s FROM rows GROUP BY ALL),
    others AS (SELECT a.fold, a.g, sum(b.s) / sum(b.n) AS fitted FROM cells a JOIN cells b ON a.g = b.g AND a.fold <> b.fold GROUP BY ALL),
    means AS (SELECT a.fold, sum(b.y) / count(*) AS rest FROM (SELECT DISTINCT fold FROM rows) a JOIN rows b ON a.fold <> b.fold GROUP BY a.fold),
    held AS (SELECT fold, 1 - sum((y - fitted) ** 2) / var_pop(y) / count(*) AS model, 1 - sum((y - rest) ** 2) / var_pop(y) / count(*) AS base
      FROM rows JOIN others USING (fold, g) JOIN means USING (fold) GROUP BY fold),
    whole AS (SELECT count(*) AS n, count(DISTINCT g) AS p, 1 - sum((y - m) ** 2) / var_pop(y) / count(*) AS r2
      FROM (SELECT *, avg(y) OVER (PARTITION BY g) AS m FROM rows))
    SELECT CAST(n AS DOUBLE) AS n, round(r2, 9) AS r2, round(1 - (1 - r2) * (n - 1) / (n - p), 9) AS adj_r2, round(avg(model), 9) AS model_r2,
      round(stddev_pop(model), 9) AS model_r2_std, round(avg(base), 9) AS baseline_r2 FROM whole, held GROUP BY n, p, r2""",
)
check("tests_table", lambda s, d: analysis(s, d).tables["tests"])
check(
    "tests_statistics",
    lambda s, d: rounded(analysis(s, d).tables["tests"], statistic=6, effect_size=9).select(
        "question", "factor", "test", "n", "statistic", "effect_size", "effect_label"
    ),
    f"""{ALL_SQL}, rhos AS ({' UNION ALL '.join([rho_sql(c, 'factors') for c in M.NUMERIC_FACTORS] + [rho_sql('members', 'population')])}),
    found AS (SELECT 'Q1' AS question, 'kruskal' AS test, * FROM ({kruskal_sql('category_rows')})
      UNION ALL SELECT 'Q1', 'kruskal', * FROM ({kruskal_sql('tag_rows')}) UNION ALL SELECT 'Q3', 'kruskal', * FROM ({kruskal_sql('top_rows')})
      UNION ALL SELECT CASE factor WHEN 'members' THEN 'Q2' ELSE 'Q1' END, 'spearman', factor, n, round(statistic, 6), effect_size FROM rhos)
    SELECT question, factor, test, n, statistic, effect_size,
      CASE WHEN effect_size < 0.01 THEN 'negligible' WHEN effect_size < 0.06 THEN 'small' WHEN effect_size < 0.14 THEN 'medium' ELSE 'large' END AS effect_label
    FROM found""",
)


def _whole_analysis(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """Every row of every result table of a run, as (table_name, row)."""
    results = A.analyze(X.titles(spark, folder), X.tables(spark, folder))
    rows = None
    for name, table in {**results.tables, "summary": O.summary(spark, results)}.items():
        part = table.select(F.lit(name).alias("table_name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


check("analysis_all", _whole_analysis)
check(
    "median_ci_resampled",
    lambda s, d: R.resampled_medians(R.category_cells(kept_factors(s, d), CATEGORIES)),
)
check(
    "group_report",
    lambda s, d: P.group_report(analysis(s, d).tables["factor_groups"]).select("place", "factor", "group", "n", "median"),
    f"""{BASE}, {FACTORS_SQL}, {CATEGORY_SQL}, medians AS (SELECT factor, grp AS "group", count(*) AS n, quantile_cont(score, 0.5) AS median FROM category_rows GROUP BY ALL)
    SELECT CAST(row_number() OVER (ORDER BY list_position({CATEGORIES!r}, factor), median DESC, "group") AS INTEGER) AS place, * FROM medians""",
)
LABEL_SQL = "CASE WHEN {0} < 0.01 THEN 'negligible' WHEN {0} < 0.06 THEN 'small' WHEN {0} < 0.14 THEN 'medium' ELSE 'large' END"


def _outputs(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The analysis tables and the summary of a run, written, opened again, and put into one table."""
    root = working_path(spark, "outputs")
    O.write_analysis(spark, root, analysis(spark, folder), _funnel(spark, folder)[0])
    t = S.load_tables(spark, root, O.ANALYSIS_TABLES, "summary")
    slash = lambda *c: F.concat_ws("/", *c)
    parts = {
        "tests": (slash("question", "factor"), "n", F.round("effect_size", 9)),
        "factor_groups": (slash("factor", "group"), "n", "median"),
        "tag_effects": ("factor", "n_with", F.round("difference", 6)),
        "ols_coefficients": ("term", F.lit(1), F.lit(0)),
        "popularity_deciles": ("decile", "n", "median"),
        "top250_tags": ("factor", "n_with_top250", F.round("share_population", 9)),
        "numeric_bins": (slash("factor", "group"), "n", "median"),
    }
    rows = t["summary"].select(
        F.lit("summary").alias("table_name"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n"), F.lit(0.0).alias("value")) for c in ("model_n", "rows_dropped", "population_n", "top250_n")])),
    )
    column = lambda c: F.col(c) if isinstance(c, str) else c
    for name, (key, n, value) in parts.items():
        rows = rows.unionByName(t[name].select(
            F.lit(name).alias("table_name"), column(key).cast("string").alias("key"), column(n).cast("bigint").alias("n"), column(value).cast("double").alias("value")
        ))
    return rows


check(
    "outputs",
    _outputs,
    f"""{ALL_SQL}, {RANGE_SQL}, {_COMPLETE}, {LEVELS_SQL.replace("FROM factors", "FROM complete")},
    rhos AS ({' UNION ALL '.join([rho_sql(c, 'factors') for c in M.NUMERIC_FACTORS] + [rho_sql('members', 'population')])}),
    deciles AS (SELECT *, ntile(10) OVER (ORDER BY members, mal_id) AS decile FROM population),
    bins AS ({" UNION ALL ".join(_bin_sql(f) for f in M.BIN_EDGES)}),
    found AS (SELECT 'Q1' AS question, factor, n, effect_size FROM ({kruskal_sql('category_rows')}) UNION ALL SELECT 'Q1', factor, n, effect_size FROM ({kruskal_sql('tag_rows')})
      UNION ALL SELECT 'Q3', factor, n, effect_size FROM ({kruskal_sql('top_rows')})
      UNION ALL SELECT CASE factor WHEN 'members' THEN 'Q2' ELSE 'Q1' END, factor, n, effect_size FROM rhos),
    terms AS (SELECT unnest(['const', 'log1p(episodes)', 'log1p(duration_min)', 'year']) AS term UNION ALL SELECT factor FROM chosen
      {" ".join(f"UNION ALL SELECT DISTINCT '{c}=' || {c} FROM complete WHERE {c} <> (SELECT reference FROM refs WHERE factor = '{c}')" for c in CATEGORIES)}),
    rows AS (SELECT 'tests' AS table_name, question || '/' || factor AS key, n, effect_size AS value FROM found
      UNION ALL SELECT 'factor_groups', factor || '/' || grp, count(*), quantile_cont(score, 0.5) FROM category_rows GROUP BY factor, grp
      UNION ALL SELECT 'tag_effects', factor, count(*) FILTER (grp = 'true'),
        round(quantile_cont(score, 0.5) FILTER (grp = 'true') - quantile_cont(score, 0.5) FILTER (grp = 'false'), 6) FROM tag_rows GROUP BY factor
      UNION ALL SELECT 'ols_coefficients', term, 1, 0 FROM terms
      UNION ALL SELECT 'popularity_deciles', CAST(decile AS VARCHAR), count(*), quantile_cont(CAST(score AS DOUBLE), 0.5) FROM deciles GROUP BY decile
      UNION ALL SELECT 'top250_tags', factor, n_with_top250, round(share_population, 9) FROM ranges
      UNION ALL SELECT 'numeric_bins', factor || '/' || "group", n, median FROM bins
      UNION ALL SELECT 'summary', 'model_n', count(*), 0 FROM complete
      UNION ALL SELECT 'summary', 'rows_dropped', (SELECT count(*) FROM factors) - count(*), 0 FROM complete
      UNION ALL SELECT 'summary', 'population_n', count(*), 0 FROM factors
      UNION ALL SELECT 'summary', 'top250_n', count(*), 0 FROM top_ids)
    SELECT table_name, key, CAST(n AS BIGINT) AS n, CAST(value AS DOUBLE) AS value FROM rows""",
)


# -- report tables: checked on what the statistics above gave ------------------------------------
NAME_SQL = "CASE factor " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FACTOR_NAMES.items()) + " END"
check(
    "factor_ranking",
    lambda s, d: rounded(P.factor_ranking(analysis(s, d).tables["tests"]), effect_size=9).select("factor", "name", "effect_size"),
    f"""{BASE}, {FACTORS_SQL}, {CATEGORY_SQL} SELECT factor, {NAME_SQL} AS name, effect_size FROM (
      SELECT factor, effect_size FROM ({kruskal_sql('category_rows')})
      UNION ALL SELECT factor, effect_size FROM ({' UNION ALL '.join(rho_sql(c, 'factors') for c in M.NUMERIC_FACTORS)}))""",
)
check(
    "best_group",
    lambda s, d: P.best_group(analysis(s, d).tables["factor_groups"]).select("factor", "n", "median"),
    f"""{BASE}, {FACTORS_SQL}, {CATEGORY_SQL} SELECT factor, n, median FROM (
      SELECT factor, count(*) AS n, quantile_cont(score, 0.5) AS median FROM category_rows GROUP BY factor, grp)
    QUALIFY row_number() OVER (PARTITION BY factor ORDER BY median DESC, n DESC) = 1""",
)
check(
    "tag_report",
    lambda s, d: rounded(
        P.tag_report(analysis(s, d).tables["tag_effects"], analysis(s, d).tables["tests"]), effect_size=9
    ).select("factor", "name", "n_with", "median_with", "effect_size", "effect_label"),
    f"""{ALL_SQL}, k AS ({kruskal_sql('tag_rows')}) SELECT factor, substring(factor, strpos(factor, '=') + 1) || ' (' || split_part(factor, '=', 1) || ')' AS name,
      count(*) FILTER (grp = 'true') AS n_with, quantile_cont(score, 0.5) FILTER (grp = 'true') AS median_with, any_value(effect_size) AS effect_size,
      CASE WHEN any_value(effect_size) < 0.01 THEN 'negligible' WHEN any_value(effect_size) < 0.06 THEN 'small' WHEN any_value(effect_size) < 0.14 THEN 'medium' ELSE 'large' END AS effect_label
    FROM tag_rows JOIN k USING (factor) GROUP BY factor""",
)
DIFFERENCE_SQL = "gaps AS (SELECT factor, quantile_cont(score, 0.5) FILTER (grp = 'true') - quantile_cont(score, 0.5) FILTER (grp = 'false') AS difference FROM tag_rows GROUP BY factor)"
check(
    "range_report",
    lambda s, d: (
        lambda t: rounded(
            P.range_report(t["top250_tags"], t["tag_effects"], t["tests"]),
            share_top250=9, difference=6, difference_top250=6, effect_size=9, effect_size_top=9,
        ).select("factor", "share_top250", "difference", "difference_top250", "effect_size", "effect_size_top")
    )(analysis(s, d).tables),
    f"""{ALL_SQL}, {RANGE_SQL}, {DIFFERENCE_SQL}, k AS ({kruskal_sql('tag_rows')}), k3 AS ({kruskal_sql('top_rows')})
    SELECT factor, round(share_top250, 9) AS share_top250, round(difference, 6) AS difference, round(difference_top250, 6) AS difference_top250,
      k.effect_size, k3.effect_size AS effect_size_top FROM ranges JOIN gaps USING (factor) LEFT JOIN k USING (factor) LEFT JOIN k3 USING (factor)""",
)
check(
    "range_gaps",
    lambda s, d: rounded(
        P.range_gaps(analysis(s, d).tables["top250_tags"], analysis(s, d).tables["tag_effects"]), difference=6, difference_top250=6, size=6
    ),
    f"""{ALL_SQL}, {RANGE_SQL}, {DIFFERENCE_SQL} SELECT factor, round(difference, 6) AS difference, round(difference_top250, 6) AS difference_top250, n_with_top250,
      substring(factor, strpos(factor, '=') + 1) || ' (' || split_part(factor, '=', 1) || ')' AS name, round(abs(difference), 6) AS size
    FROM ranges JOIN gaps USING (factor) WHERE difference_top250 IS NOT NULL""",
)


def _studio_coefficients(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The fit's own coefficients of one factor with many levels."""
    df = kept_factors(spark, folder)
    return spark.createDataFrame(fit(df, "mal_id", "score", design(df, {}, ["studio_group"], {}))[0])


_COEFFICIENTS = f"""{GROUPS_SQL},
c AS (SELECT 'season=' || s.g AS term, s.g || ' (studio)' AS name, s.mean - b.mean AS coef, sqrt(s.var + b.var) AS std_err FROM spread s, base b WHERE s.g <> b.g)"""
STUDIO_SQL = f"{BASE}, {FACTORS_SQL}, " + _COEFFICIENTS.replace("season", "studio_group")
SEASON_SQL = f"{BASE}, {FACTORS_SQL}, {_COEFFICIENTS}"
check(
    "top_coefficients",
    lambda s, d: rounded(P.top_coefficients(_studio_coefficients(s, d), 10), coef=9, std_err=9, size=9).select("term", "name", "coef", "std_err", "size"),
    f"""{STUDIO_SQL} SELECT term, name, round(coef, 9) AS coef, round(std_err, 9) AS std_err, round(abs(coef), 9) AS size FROM c ORDER BY abs(coef) DESC, term LIMIT 10""",
)
check(
    "coef_extremes",
    lambda s, d: rounded(P.coefficient_extremes(s.createDataFrame(_one_factor(s, d)[0]), 4), coef=9).select("term", "coef"),
    f"""{SEASON_SQL}, u AS (SELECT * FROM c WHERE abs(coef / std_err) > 1.959963984540054)
    SELECT term, round(coef, 9) AS coef FROM (SELECT * FROM (SELECT * FROM u ORDER BY coef DESC, term LIMIT 4) UNION SELECT * FROM (SELECT * FROM u ORDER BY coef, term DESC LIMIT 4))""",
)
check(
    "group_report",
    lambda s, d: P.group_report(analysis(s, d).tables["factor_groups"]).select("factor", "group", "n", "median"),
    f"""{BASE}, {FACTORS_SQL}, {CATEGORY_SQL} SELECT factor, grp AS "group", count(*) AS n, quantile_cont(score, 0.5) AS median FROM category_rows GROUP BY factor, grp""",
)
check(
    "strongest_factors",
    lambda s, d: rounded(P.strongest(analysis(s, d).tables["tests"]), statistic=6, effect_size=9).select("factor", "n", "statistic", "effect_size"),
    f"""{ALL_SQL} SELECT factor, n, statistic, effect_size FROM (
      SELECT * FROM ({kruskal_sql('category_rows')}) UNION ALL SELECT * FROM ({kruskal_sql('tag_rows')})
      UNION ALL SELECT factor, n, round(statistic, 6), effect_size FROM ({' UNION ALL '.join(rho_sql(c, 'factors') for c in M.NUMERIC_FACTORS)}))
    ORDER BY effect_size DESC, factor LIMIT 3""",
)
check(
    "factor_test",
    lambda s, d: rounded(P.factor_test(analysis(s, d).tables["tests"], "source"), statistic=6, effect_size=9).select("factor", "n", "statistic", "effect_size"),
    f"""{BASE}, {FACTORS_SQL}, {CATEGORY_SQL} SELECT * FROM ({kruskal_sql('category_rows')}) WHERE factor = 'source'""",
)
check(
    "findings_facts",
    lambda s, d: P.findings(analysis(s, d).tables, _funnel(s, d)[0], O.summary(s, analysis(s, d))).select(
        "n_tests", "n_tags", "model_n", "rows_dropped", "population_n", "top250_n", "popularity_label", "year_label", "any_large",
        F.array_join(F.transform(F.array_sort(F.map_entries("references")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("references"),
        F.round("popularity_rho", 6).alias("popularity_rho"), F.round("year_rho", 6).alias("year_rho"),
        F.round("mean_gap_population", 6).alias("mean_gap_population"), F.round("mean_gap_top250", 6).alias("mean_gap_top250"),
        "recent_titles", "lowest_decile_median", "highest_decile_median",
    ),
    f"""{ALL_SQL}, {RANGE_SQL}, {DIFFERENCE_SQL}, {_COMPLETE}, {LEVELS_SQL.replace("FROM factors", "FROM complete")}, k3 AS ({kruskal_sql('top_rows')}), t AS (SELECT *, ntile(10) OVER (ORDER BY members, mal_id) AS decile FROM population)
    SELECT (SELECT count(*) FROM chosen) + (SELECT count(*) FROM k3) + 10 AS n_tests, (SELECT count(*) FROM chosen) AS n_tags,
      (SELECT count(*) FROM complete) AS model_n, (SELECT count(*) FROM factors) - (SELECT count(*) FROM complete) AS rows_dropped,
      (SELECT count(*) FROM factors) AS population_n, (SELECT count(*) FROM top_ids) AS top250_n,
      (SELECT {LABEL_SQL.format('effect_size')} FROM ({rho_sql('members', 'population')})) AS popularity_label,
      (SELECT {LABEL_SQL.format('effect_size')} FROM ({rho_sql('year', 'factors')})) AS year_label,
      (SELECT max(effect_size) >= 0.14 FROM (SELECT effect_size FROM ({kruskal_sql('category_rows')}) UNION ALL SELECT effect_size FROM ({kruskal_sql('tag_rows')})
        UNION ALL SELECT effect_size FROM ({' UNION ALL '.join(rho_sql(c, 'factors') for c in M.NUMERIC_FACTORS)}))) AS any_large,
      (SELECT string_agg(factor || '=' || reference, '|' ORDER BY factor) FROM refs) AS "references",
      (SELECT round(statistic, 6) FROM ({rho_sql('members', 'population')})) AS popularity_rho,
      (SELECT round(statistic, 6) FROM ({rho_sql('year', 'factors')})) AS year_rho,
      (SELECT round(avg(abs(difference)), 6) FROM gaps) AS mean_gap_population,
      (SELECT round(avg(abs(difference_top250)), 6) FROM ranges) AS mean_gap_top250,
      (SELECT count(*) FROM titles WHERE year > 2024) AS recent_titles,
      (SELECT quantile_cont(CAST(score AS DOUBLE), 0.5) FROM t WHERE decile = 1) AS lowest_decile_median,
      (SELECT quantile_cont(CAST(score AS DOUBLE), 0.5) FROM t WHERE decile = 10) AS highest_decile_median""",
)
