"""The stages together, each against a plain count of what it must have done."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_stages(spark, tmp_path):
    kept = {}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    con = duckdb.connect()
    raw = con.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    quality = dict(con.execute(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    first = {r.doc_id: r.text for r in kept["quality"]}
    assert 0 < len(first) < len(raw) and sum(quality[i] == (i in first) for i in quality) >= 0.97 * len(quality)
    near = {r.doc_id for r in kept["near_copies"]}
    assert near == {row[0] for row in brute(list(first.items()), 5) if row[3]}
    letters = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip()
    items = [letters(t) for (t,) in con.execute(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    assert {r.doc_id for r in kept["leaks"]} == {i for i in near if not any(x in letters(first[i]) for x in items)}
    times = Counter(r.doc_id for r in kept["mixing"])
    assert set(times) <= {r.doc_id for r in kept["leaks"]} and max(times.values()) <= 2
    assert Counter(r.doc_id for r in kept["token_files"]) == times
    assert kept["token_files"][0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32", "part"}


def test_token_files_follow_the_mix(spark, tmp_path):
    rows = [(i, f"w{i} " * (1 + i % 7), "en", "abc"[i % 3], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, "")
    expected = [r.doc_id for r in mixed.collect()]
    assert expected != sorted(expected)
    mixed.write.parquet(f"{tmp_path}/mix")
    for given in (spark.read.parquet(f"{tmp_path}/mix"), mixed):
        got = sorted(stages["token_files"](spark, given, "").collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == expected


def test_awkward_documents(spark, awkward, nothing, tmp_path):
    benchmark = spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string")
    spark.createDataFrame([(1, 1), (8, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, least in ((awkward, 4), (nothing, 0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{least}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{least}")
            assert docs.count() >= least
            assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
            if name == "near_copies" and least:
                assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 1


def test_repeated_ids_of_different_texts_are_judged_each_for_itself(spark):
    near = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark green forest to sleep there for a long long time until the morning comes again"
    other, lone = "an entirely different text of its own with enough words to count here", "yet another text that has no id and no copy among all of these rows"
    rows = [(1, near, "en", "a", 0), (5, near + " end", "en", "a", 0), (5, other, "en", "b", 1), (5, other, "en", "b", 1), (None, lone, "de", "a", 0), (None, lone + " x", None, "a", 0),
            (None, "", "en", "a", 0), (9, None, "en", "a", 0), (9, " ", "en", "a", 0)]
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    expected = None
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = sorted((tuple(r) for r in stage(spark, docs, "").collect()), key=repr)
        expected = expected or got
        assert got == expected
        assert [r[:2] for r in got if r[0] is not None] == [(1, near), (5, other), (9, " "), (9, None)]
        assert sorted(r[1] for r in got if r[0] is None)[0] == "" and len([r for r in got if r[0] is None]) == 2
