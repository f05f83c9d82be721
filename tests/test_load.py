"""Cleaning, merging and whole runs: what a load leaves behind."""

import pytest
from pyspark.sql import functions as F

from tests.test_sources import land, page, write_snapshot
from titleworks.operators import cleaning as N
from titleworks.operators import merge as G
from titleworks.plans import pipeline as Q
from titleworks.schemas import SNAPSHOT_COLUMNS
from titleworks.streaming.refresh import landed_pages, refresh

TAGS = [(2, "Adventure", "genre"), (8, "Drama", "genre"), (26, "Girls Love", "genre"), (27, "Shounen", "demographic")]
ROWS = [
    {"mal_id": "1", "title": "One", "genres": "Adventure, Drama", "studios": "Lantern, Inc.", "members": "10"},
    {"mal_id": "2", "title": "Two", "genres": "Shoujo Ai, Made Up", "rating": "Rx - Adults"},
    {"mal_id": "3", "title": "Three", "genres": "Shoujo Ai, Made Up, Drama, Drama", "demographics": "Shounen", "producers": "Pier", "licensors": "Pier"},
    {"mal_id": "1", "title": "One again", "genres": "Drama", "studios": "Lantern, Inc.", "members": "11"},
]


@pytest.fixture
def reference(spark):
    return spark.createDataFrame(TAGS, "genre_id bigint, name string, kind string")


def records(spark, rows, source="kaggle"):
    cells = [tuple(r.get(c) for c in SNAPSHOT_COLUMNS) + (i,) for i, r in enumerate(rows)]
    schema = ", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS) + ", _seq bigint"
    return N.clean_snapshot(spark.createDataFrame(cells, schema), source, "_seq")


def content(state):
    return {
        "titles": sorted((r.mal_id, r.title, r.data_source) for r in state["titles"].collect()),
        "title_tags": sorted(map(tuple, state["title_tags"].collect())),
        "companies": sorted((r.name, r.mal_id) for r in state["companies"].collect()),
        "title_companies": sorted(map(tuple, state["title_companies"].select("anime_id", "role").collect())),
    }


def test_prepare_drops_excluded_then_keeps_the_last(spark):
    made = records(spark, ROWS)
    assert sorted((r.mal_id, r.title) for r in N.prepare(made).collect()) == [(1, "One again"), (3, "Three")]
    counts = N.prepare_counts(made).first()
    assert (counts.raw_rows, counts.rx_dropped, counts.duplicates_dropped, counts.kept) == (4, 1, 1, 2)


def test_last_record_wins_even_for_one_very_common_id(spark):
    many = spark.range(50_000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 7 END AS k", "id AS at", "cast(id as string) AS v")
    last = {r.k: r.v for r in N.last_per_key(many, "k", "at").collect()}
    assert last[7] == "49999" and len(last) == 16_667 + 1


def test_both_sources_give_the_same_shape(spark, tmp_path):
    landed = Q.read_pages(spark, land(tmp_path, [page(1, [1])]), "top", 1)
    made = Q.page_records(landed)
    assert made.columns == records(spark, ROWS).columns
    row = made.first()
    assert (row.mal_id, row.data_source, row.tags, row.companies, row.year) == (1, "api", ["Drama"], [], None)


def test_load_twice_changes_nothing_and_links_follow_the_newest(spark, reference):
    state, lost = Q.load(None, N.prepare(records(spark, ROWS)), reference)
    assert content(state) == {
        "titles": [(1, "One again", "kaggle"), (3, "Three", "kaggle")],
        "title_tags": [(1, 8), (3, 8), (3, 26), (3, 27)],
        "companies": [("Lantern, Inc.", None), ("Pier", None)],
        "title_companies": [(1, "studio"), (3, "licensor"), (3, "producer")],
    }
    assert [tuple(r) for r in lost.collect()] == [("Made Up", 1)]
    again, _ = Q.load(state, N.prepare(records(spark, ROWS)), reference)
    assert content(again) == content(state)
    newer, _ = Q.load(state, N.prepare(records(spark, [{"mal_id": "3", "title": "New", "genres": "Adventure"}], "api")), reference)
    assert content(newer)["title_tags"] == [(1, 8), (3, 2)]
    assert content(newer)["titles"][1] == (3, "New", "api")
    assert content(newer)["title_companies"] == [(1, "studio")]


def test_company_ids_are_filled_in_and_never_erased(spark):
    companies = "array<struct<name: string, role: string, mal_id: bigint>>"
    batch = lambda rows: G.batch_companies(spark.createDataFrame(rows, f"_seq bigint, companies {companies}"))
    first = G.merge_companies(None, batch([(2, [("A", "studio", 12), ("B", "studio", None)]), (1, [("A", "studio", None), ("A", "producer", 11)])]))
    assert sorted((r.name, r.mal_id) for r in first.collect()) == [("A", 11), ("B", None)]
    later = G.merge_companies(first, batch([(1, [("A", "studio", None), ("B", "studio", 5), ("C", "studio", None)])]))
    assert sorted((r.name, r.mal_id) for r in later.collect()) == [("A", 11), ("B", 5), ("C", None)]
    ids = {r.name: r.company_id for r in later.collect()}
    assert {r.name: r.company_id for r in first.collect()}.items() <= ids.items()


def test_quality_rules_count_violations(spark, reference):
    state, _ = Q.load(None, N.prepare(records(spark, ROWS)), reference)
    assert {r.violations for r in G.quality_rules(state).collect()} == {0}
    broken = {**state, "titles": state["titles"].where("mal_id = 1").withColumn("season", F.lit("monsoon"))}
    found = {r.rule: r.violations for r in G.quality_rules(broken).collect() if r.violations}
    assert found == {"title season": 1, "tag link title": 3, "company link title": 2}


@pytest.fixture
def store(spark, tmp_path):
    return Q.Store(spark, str(tmp_path / "store"))


def test_pages_override_the_snapshot_and_the_run_is_logged(spark, store, reference, tmp_path):
    path = write_snapshot(tmp_path / "s.csv", ROWS)
    folder = land(tmp_path / "pages", [page(1, [1, 9], more=False)])
    assert Q.run(store, reference, path, folder, 3) == "success"
    assert content(store.current())["titles"] == [(1, "T1", "api"), (3, "Three", "kaggle"), (9, "T9", "api")]
    (logged,) = store.runs().collect()
    assert (logged.status, logged.anime_upserted, logged.api_pages_failed, logged.base_source) == ("success", 4, 0, "csv")
    assert logged.message == "rx_dropped=1 duplicates_dropped=1 unmatched_tags=1"
    assert logged.finished_at >= logged.started_at
    # The snapshot again, without pages: its values return, but company ids and titles stay.
    assert Q.run(store, reference, path) == "success"
    assert content(store.current())["titles"] == [(1, "One again", "kaggle"), (3, "Three", "kaggle"), (9, "T9", "api")]


def test_missing_pages_make_a_run_partial_and_keep_the_base(spark, store, reference, tmp_path):
    path = write_snapshot(tmp_path / "s.csv", ROWS)
    assert Q.run(store, reference, path, str(tmp_path / "nowhere"), 2) == "partial"
    (logged,) = store.runs().collect()
    assert logged.api_pages_failed == 2 and "API refresh failed" in logged.message
    assert store.current()["titles"].count() == 2
    folder = land(tmp_path / "pages", [page(2, [5])])
    assert Q.run(store, reference, None, folder, 2) == "partial"
    assert store.current()["titles"].count() == 3


def test_a_failed_base_load_leaves_the_last_good_tables(spark, store, reference, tmp_path):
    Q.run(store, reference, write_snapshot(tmp_path / "s.csv", ROWS))
    before = content(store.current())
    bad = write_snapshot(tmp_path / "bad.csv", [{"mal_id": "1"}], ["mal_id"])
    with pytest.raises(ValueError, match="missing required columns"):
        Q.run(store, reference, bad)
    assert sorted(r.status for r in store.runs().collect()) == ["failed", "success"]
    assert content(store.current()) == before


def test_metadata(spark, store, reference, tmp_path):
    Q.run(store, reference, write_snapshot(tmp_path / "s.csv", ROWS))
    facts = Q.metadata(store.current()).first()
    assert facts.data_source_counts == {"kaggle": 2}
    assert facts.row_counts == {"titles": 2, "tags": 4, "title_tags": 4, "companies": 2, "title_companies": 3}
    assert facts.data_last_updated is not None


def test_a_refresh_writes_the_touched_buckets_alone(spark, reference, tmp_path):
    store = Q.Store(spark, str(tmp_path / "store"), buckets=8)
    rows = [{"mal_id": str(i), "title": f"Title {i}", "genres": "Drama", "studios": f"Studio {i % 5}"} for i in range(200)]
    Q.run(store, reference, write_snapshot(tmp_path / "s.csv", rows))
    first = store.newest()
    before, old = {(e["table_name"], e["bucket"]): e["folder"] for e in store.manifest(first)}, content(store.current())
    opened = store.current()
    batch = N.prepare(records(spark, [{"mal_id": "17", "title": "New", "genres": "Adventure"}], "api"))
    store.merge("attempt", first, batch, reference)  # not logged: readers see the old tables
    assert content(store.current()) == old
    assert Q.run(store, reference, None, land(tmp_path / "pages", [page(1, [17], more=False)]), 1) == "success"
    after = {(e["table_name"], e["bucket"]): e["folder"] for e in store.manifest(store.newest())}
    changed = {k for k in after if k[1] is not None and after[k] != before.get(k)}
    assert {name for name, _ in changed} <= {"titles", "title_tags", "title_companies"} and len({b for _, b in changed}) == 1
    assert len(before) == len(after) and content(store.current())["titles"][17] == (17, "T17", "api")
    assert [t for t in content(store.current())["titles"] if t[0] != 17] == [t for t in old["titles"] if t[0] != 17]
    assert content(opened) == old  # a reader keeps the folders it has opened
    whole, _ = Q.load(store.tables(first), Q.page_records(Q.read_pages(spark, str(tmp_path / "pages"), "top", 1)), reference)
    assert content(whole) == content(store.current())


def test_a_bucket_that_loses_all_rows_is_left_out(spark, reference, tmp_path):
    store = Q.Store(spark, str(tmp_path / "store"), buckets=4, files=3)
    assert store.merge("a", None, N.prepare(records(spark, ROWS)), reference).count() == 1
    store.merge("b", "a", N.prepare(records(spark, [{"mal_id": "1", "title": "Bare"}])), reference)
    assert content(store.tables("b"))["title_tags"] == [(3, 8), (3, 26), (3, 27)]
    store.merge("c", "b", N.prepare(records(spark, [{"mal_id": "3", "title": "Bare"}])), reference)
    assert content(store.tables("c"))["title_tags"] == [] and content(store.tables("c"))["titles"] == [(1, "Bare", "kaggle"), (3, "Bare", "kaggle")]
    assert content(store.tables("a"))["title_tags"] == [(1, 8), (3, 8), (3, 26), (3, 27)]


def test_streamed_pages_merge_like_a_batch(spark, store, reference, tmp_path):
    Q.run(store, reference, write_snapshot(tmp_path / "s.csv", ROWS))
    folder = land(tmp_path / "pages", [page(1, [1, 9])])
    stream = lambda: refresh(landed_pages(spark, f"{folder}/endpoint=top", 1), store, reference, str(tmp_path / "cp"))
    stream().awaitTermination()
    assert content(store.current())["titles"] == [(1, "T1", "api"), (3, "Three", "kaggle"), (9, "T9", "api")]
    land(tmp_path / "pages", [page(2, [10])])
    stream().awaitTermination()
    assert content(store.current())["titles"][-1] == (10, "T10", "api")
    assert store.runs().count() == 3
