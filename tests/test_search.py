"""Searches for a table of queries against looking at every title."""

import random

from titleworks.plans import lookup as L

SCHEMA = "mal_id bigint, title string, title_english string, type string, year bigint, score double, members bigint"


def test_batch_search_against_every_title(spark):
    random.seed(7)
    name = lambda: "".join(random.choices("abAB c(", k=random.randint(1, 9)))
    rows = [(i, name(), random.choice([None, name()]), "TV", 2000, 1.0, random.choice([None, 1, 2, 3])) for i in range(300)]
    rows.append((900, None, "only English ab", "TV", 1, 1.0, 9))
    queries = [(k, q) for k, q in enumerate(["a", "B(", "ab", "aba", "abab", "zzz", "abz", " c", "(", "only english", "", None, "ab", "AbAb a", "%", "a_b"])]
    found = L.search_many(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(queries, "query_id int, query string"), 7).collect()
    expected = []
    for k, query in queries:
        hits = [r for r in rows if query and any(query.lower() in (t or "").lower() for t in r[1:3])]
        hits = sorted(hits, key=lambda r: (r[6] is None, -(r[6] or 0), r[0]))[:7]
        expected += [(k, rank, r[0]) for rank, r in enumerate(hits, 1)]
    assert sorted((r.query_id, r["rank"], r.mal_id) for r in found) == sorted(expected)
    nothing = spark.createDataFrame([], SCHEMA)
    assert L.search_many(nothing, spark.createDataFrame(queries, "query_id int, query string")).count() == 0


def test_titles_are_cut_into_grams_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    titles = spark.createDataFrame([(i, f"title {i}", None, "TV", 2000, 1.0, i) for i in range(50)], SCHEMA).mapInArrow(counted, SCHEMA)
    found = L.search_many(titles, spark.createDataFrame([(1, "title 4"), (2, "9")], "query_id int, query string"), 3)
    assert sorted((r.query_id, r.mal_id) for r in found.collect()) == [(1, 47), (1, 48), (1, 49), (2, 29), (2, 39), (2, 49)]
    assert seen.value == 100  # for their grams, and for the rows that are found


def test_only_the_first_titles_of_a_query_leave_a_task(spark):
    """Digits are in nearly every title; each query's rows must not be."""
    titles = spark.createDataFrame([(i, f"name {i:05d}", None, "TV", 2000, 1.0, i % 7) for i in range(4_000)], SCHEMA).coalesce(1)
    asked = spark.createDataFrame([(k, f"{k:03d}") for k in range(200)], "query_id int, query string")
    packs = asked.select("query").coalesce(1).mapInArrow(lambda batches: L._in_bytes(batches, 1_000), "packed binary")
    assert L._hits(titles, packs, 2).count() <= 2 * 200
    found = {}
    for r in L.search_many(titles, asked, 2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.mal_id)
    for k in range(200):
        hits = [i for i in range(4_000) if f"{k:03d}" in f"{i:05d}"]
        assert found[k] == sorted(hits, key=lambda i: (-(i % 7), i))[:2]


def test_runs_of_other_scripts_and_of_repeated_ids(spark):
    rows = [(1, "Déjà ÉTÉ", "été", 5), (1, "other", None, 9), (2, "日本語の本", None, None), (3, "日本", "x" * 70, 1), (None, "日本", None, 99), (4, "日本 r", None, 7), (4, "日本 r", None, 7)]
    titles = spark.createDataFrame([(i, t, e, "TV", 2000, 1.0, m) for i, t, e, m in rows], SCHEMA)
    asked = spark.createDataFrame(list(enumerate(["ÉTÉ", "日本", "語の", "x" * 65, "x" * 71, "r", "本日"])), "query_id int, query string")
    found = sorted((r.query_id, r["rank"], r.mal_id, r.members) for r in L.search_many(titles, asked, 3).collect())
    assert found == [(0, 1, 1, 5), (1, 1, 3, 1), (1, 2, 2, None), (2, 1, 2, None), (3, 1, 3, 1), (5, 1, 1, 9)]
