"""Whole-table ranks equal the plain window forms, without one task that sees all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from titleworks.operators import ranks as K


@pytest.fixture(scope="module")
def rows(spark):
    # A third of all rows share one value.
    return spark.range(20_003).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id * 7919 % 9001 END AS v").repartition(7).cache()


def test_row_numbers(rows):
    order = [F.col("v"), F.col("id")]
    plain = rows.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    assert K.row_numbers(rows, order, "n").exceptAll(plain).count() == 0


@pytest.mark.parametrize("tiles", [10, 7])
def test_ntile(rows, tiles):
    order = [F.col("v"), F.col("id")]
    plain = rows.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order)).cast("bigint"))
    assert K.ntile(rows, order, tiles, "t").exceptAll(plain).count() == 0


def test_ntile_of_few_rows(spark):
    few = spark.range(3).withColumn("v", F.lit(1))
    assert sorted(r.t for r in K.ntile(few, [F.col("v"), F.col("id")], 10, "t").collect()) == [1, 2, 3]


@pytest.mark.parametrize("bounded", [True, False])
def test_average_ranks(rows, bounded):
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    plain = (
        rows.withColumn("r", F.row_number().over(Window.orderBy("v"))).groupBy("v").agg(F.count("*").alias("n"), F.avg("r").alias("avg_rank"))
    )
    assert K.average_ranks(counts, "v", "n", bounded).exceptAll(plain).count() == 0


def test_top_with_ties(rows):
    plain = rows.withColumn("r", F.rank().over(Window.orderBy(F.desc("v"))).cast("bigint")).where("r <= 250")
    found = K.top_with_ties(rows, "v", 250, "r").select("id", "v", "r")
    assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0


def test_no_single_task_sees_all_rows(rows):
    """The sort is a range exchange, and the numbering afterwards has no data-sized window."""
    numbered = K.row_numbers(rows, [F.col("v"), F.col("id")], "n")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    data_windows = [line for line in plan.splitlines() if "Window" in line and "_part" not in line]
    assert not data_windows
