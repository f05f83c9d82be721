import os

import pytest
from pyspark.sql import functions as F

from checks import recommend as C
from checks import tables as X
from checks.cleaning import _funnel
from checks.statistics import analysis
from titleworks.plans import outputs as O
from titleworks.plans import pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_every_output_is_written_and_read_back(spark, tmp_path):
    root = str(tmp_path / "out")
    results, funnel = analysis(spark, FOLDER), _funnel(spark, FOLDER)[0]
    titles, links, rows = X.docs(spark, FOLDER), X.doc_links(spark, FOLDER), C.profiles(spark, FOLDER)
    asked = [r.mal_id for r in rows.where("eligible").orderBy("mal_id").limit(3).collect()] + [-1]
    facts = pipeline.metadata({"titles": X.titles(spark, FOLDER), **X.tables(spark, FOLDER)})
    written = O.write_all(root, results, funnel, C.catalog(spark, FOLDER), facts, titles, links, rows, asked)
    assert len(written) == 15 and written[-1].endswith("metadata")
    found = O.open_all(spark, root)
    assert set(found) == {*O.ANALYSIS_TABLES, *O.FACTS, "catalog", "recommendations"}
    for name, table in {**results.tables, "funnel": funnel}.items():
        assert found[name].columns == table.columns and found[name].count() == table.count() > 0
    assert found["summary"].first().model_n == results.model_fit["n"]
    assert found["summary"].first().references.asDict() == results.references
    picks = C.picks(spark, FOLDER)
    assert found["recommendations"].count() == picks.count()
    evaluation = found["recommender_eval"].first()
    assert evaluation.recommendation_rows == picks.count()
    assert [c.mal_id for c in evaluation.spot_checks] == asked[:3] and all(c.picks for c in evaluation.spot_checks)
    assert len(evaluation.spot_checks_without_series_rule) == 3
    of_files = found["recommendations"].withColumn("file", F.input_file_name()).groupBy("anime_id").agg(F.count_distinct("file").alias("n"))
    assert of_files.where("n > 1").isEmpty()


def test_a_table_that_is_missing_or_unknown_is_named(spark, tmp_path):
    results, funnel = analysis(spark, FOLDER), _funnel(spark, FOLDER)[0]
    short = type(results)({k: v for k, v in results.tables.items() if k != "tests"}, results.model_fit, results.references)
    with pytest.raises(ValueError, match="tests"):
        O.write_analysis(spark, str(tmp_path), short, funnel)
    with pytest.raises(FileNotFoundError, match="by_decade"):
        O.open_all(spark, str(tmp_path / "none"))
