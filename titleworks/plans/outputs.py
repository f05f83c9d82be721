"""One job that writes every result: analysis tables, catalog, picks, and the one-row facts about them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleworks.plans import recommender as R
from titleworks.plans.analysis import Results
from titleworks.session import settle
from titleworks.sources import sinks as S

ANALYSIS_TABLES = [
    "funnel", "tests", "factor_groups", "tag_effects", "ols_coefficients", "popularity_deciles", "top250_tags", "by_year",
    "by_decade", "numeric_bins",
]
FACTS = ["summary", "metadata", "recommender_eval"]


def summary(spark: SparkSession, results: Results) -> DataFrame:
    """One row: what the model explains, and of how many titles."""
    fit = results.model_fit
    row = {"model_r2": float(fit["model_r2"]), "baseline_r2": float(fit["baseline_r2"]), "r2": float(fit["r2"]), "adj_r2": float(fit["adj_r2"])}
    row |= {"model_n": int(fit["n"]), "rows_dropped": int(fit["rows_dropped"])}
    row |= {"population_n": int(fit["population_n"]), "top250_n": int(fit["top250_n"])}
    types = ", ".join(f"{c} {'double' if isinstance(v, float) else 'bigint'}" for c, v in row.items())
    facts = spark.createDataFrame([tuple(row.values())], types)
    references = json.dumps(results.references, sort_keys=True)
    return facts.withColumn("references", F.from_json(F.lit(references), "map<string,string>"))


def write_analysis(spark: SparkSession, root: str, results: Results, funnel: DataFrame) -> list[str]:
    """The ten analysis tables and the summary. Returns the paths."""
    tables = {"funnel": funnel, **results.tables}
    unknown = set(tables) ^ set(ANALYSIS_TABLES)
    if unknown:
        raise ValueError(f"missing or unknown tables: {', '.join(sorted(unknown))}")
    written = [S.write_table(tables[name], root, name) for name in ANALYSIS_TABLES]
    return [*written, S.write_facts(summary(spark, results), root, "summary")]


def write_picks(root: str, titles: DataFrame, links: DataFrame, rows: DataFrame, asked: list[int]) -> list[str]:
    """The picks, sorted for lookups, and their evaluation with the asked titles' first picks.

    The spot checks are made again without the rule on series, for the asked titles alone.
    """
    picks = settle(R.top_k(rows), "picks")
    lists = S.write_lookup(R.recommendations(picks), root, "recommendations", "anime_id", ["anime_id", "rank"])
    free = R.top_k(rows, query_ids=asked, skip_series=False)
    facts = R.evaluation(rows, picks, links).withColumn("_one", F.lit(1))
    for name, found in (("spot_checks", picks), ("spot_checks_without_series_rule", free)):
        checks = R.spot_checks(found, titles, asked).agg(F.sort_array(F.collect_list(F.struct("mal_id", "title", "picks"))).alias(name))
        facts = facts.join(checks.withColumn("_one", F.lit(1)), "_one")
    return [lists, S.write_facts(facts.drop("_one"), root, "recommender_eval")]


def write_all(
    root: str, results: Results, funnel: DataFrame, catalog: DataFrame, metadata: DataFrame,
    titles: DataFrame, links: DataFrame, rows: DataFrame, asked: list[int],
) -> list[str]:
    """Every output of a run below root, the metadata last: where it lies, the rest is complete."""
    spark = catalog.sparkSession
    written = write_analysis(spark, root, results, funnel)
    written += write_picks(root, titles, links, rows, asked)
    written.append(S.write_table(catalog, root, "catalog"))
    return [*written, S.write_facts(metadata, root, "metadata")]


def open_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every output by name; all that are missing are named in the error."""
    tables = S.load_tables(spark, root, [*ANALYSIS_TABLES, "catalog", "recommendations"], FACTS[0])
    for name in FACTS[1:]:
        tables |= S.load_tables(spark, root, [], name)
    return tables
