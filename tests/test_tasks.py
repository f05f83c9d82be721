"""Rows that grow many times in a task are dealt over tasks by their number."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import functions as F

from checks import cleaning as Q
from checks import tables as X
from titleworks.functions import cells as C


def tables(spark, folder, n: int) -> str:
    day = datetime.datetime(1998, 2, 6)
    orders = [(k, k % 7, "OFP"[k % 3], 1000.0 + 100 * k, day, "5-LOW") for k in range(n)]
    orders += [(None, k % 7, "O", 5.0 + k, day, "5-LOW") for k in range(n)]  # keys may be null
    kinds = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, kinds).write.parquet(f"{folder}/orders.parquet")
    customers = [(k, f"Customer#{k}", 2, 1.0, "MACHINERY") for k in range(7)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.range(0, n, 2).select(F.col("id").alias("l_orderkey")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def task_rows(df) -> list[int]:
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


def test_snapshot_rows_are_dealt_by_number(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, 2000)
    monkeypatch.setattr(X, "TASK_ROWS", 100)
    rows = task_rows(X.raw(spark, folder))
    assert sum(rows) == 4000
    assert max(rows) < 250


def test_pages_are_landed_packed_and_in_bounded_files(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, 2000)
    monkeypatch.setattr(X, "TASK_ROWS", 250)
    pages = Q.page_folder(spark, folder)
    landed = [name for name in os.listdir(f"{pages}/endpoint=top") if not name.startswith((".", "_"))]
    assert len(landed) > 4
    assert all(name.endswith(".json.gz") for name in landed)
    rows = spark.read.json(f"{pages}/endpoint=top")
    assert rows.count() == 81  # 80 pages, and the titles without an id
    assert rows.where("page is not null").select(F.sum(F.size("data"))).first()[0] == 2000


def test_loaded_titles_hold_what_the_funnel_reads(spark, tmp_path):
    folder = tables(spark, tmp_path, 400)
    loaded = Q._loaded(spark, folder)
    assert set(loaded.columns) == {*Q.FUNNEL_COLUMNS, "updated_at"}
    assert loaded.count() == 200
    assert loaded.where("data_source = 'api'").count() == 200


def test_lists_are_cut_at_commas_with_any_white_space(spark):
    cells = ["a , b　, c", ",a,, b ,", " Unknown ", "", None, "x\x01y, z", "Unknown, a"]
    df = spark.createDataFrame([(c,) for c in cells], "cell string").select(
        C.split_list(F.col("cell")).alias("plain"), C.listed_names(C.clean_text(F.col("cell"))).alias("trimmed")
    )
    expected = [["a", "b", "c"], ["a", "b"], [], [], [], ["x\x01y", "z"], ["Unknown", "a"]]
    assert [r.plain for r in df.collect()] == expected
    assert [r.trimmed for r in df.collect()] == expected


def test_links_are_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, 10)
    lines = spark.range(0, 6000).selectExpr("id DIV 3 AS l_orderkey", "id % 50 AS l_partkey", "id % 20 AS l_suppkey", "'A' AS l_returnflag")
    lines = lines.union(lines.limit(300)).union(lines.selectExpr("NULL", "l_partkey", "l_suppkey", "l_returnflag").limit(60))  # repeats, and no key
    lines.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    parts = spark.range(0, 50).selectExpr("id AS p_partkey", "'Brand#' || (1 + id % 9) AS p_brand", "'SMALL' AS p_type", "CAST(id AS INT) AS p_size")
    parts.write.parquet(f"{folder}/part.parquet")
    spark.range(0, 20).selectExpr("id AS s_suppkey", "'S' || id AS s_name").write.parquet(f"{folder}/supplier.parquet")
    monkeypatch.setattr(X, "TASK_LINES", 300)
    made = X.tables(spark, folder)
    for name in ("title_tags", "title_companies"):
        rows = task_rows(made[name])
        assert len(rows) > 15, name
        assert max(rows) < 3 * sum(rows) / len(rows), name
        assert made[name].count() == made[name].distinct().count() == sum(rows), name
    assert sum(task_rows(made["title_companies"])) == 6000 + 20
