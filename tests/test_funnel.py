"""The funnel agrees with sets and counters over generated sources."""

import random
from collections import Counter

import pytest

from titleworks.plans.funnel import STEPS, build_funnel, snapshot_counts, source_counts

RATINGS = [None, "G", "R - 17+", "Rx - Hentai"]


def generated(seed):
    """A snapshot with repeats and excluded rows, and a store that overlaps it in part."""
    pick = random.Random(seed)
    rows = [(pick.randrange(40), pick.choices(RATINGS, (3, 3, 3, 2))[0]) for _ in range(pick.randrange(30, 90))]
    kept = {i for i, rating in rows if rating != RATINGS[3]}
    stored = {i: pick.choice(["kaggle", "api"]) for i in range(60) if (pick.random() < 0.8 if i in kept else pick.random() < 0.2)}
    return rows, kept, stored


def tables(spark, rows, stored, passed):
    sources = source_counts(spark.createDataFrame(rows, "mal_id long, rating string"), spark.createDataFrame(list(stored.items()), "mal_id long, data_source string"))
    return sources, spark.createDataFrame([passed], "in_database long, has_score long, enough_members long, has_aired long")


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_every_step_is_a_set_difference(spark, seed):
    rows, kept, stored = generated(seed)
    passed = (len(stored), len(stored) - 3, len(stored) - 3, len(stored) - 8)
    shown, refreshed = build_funnel(*tables(spark, rows, stored, passed))
    excluded = sum(rating == RATINGS[3] for _, rating in rows)
    repeats = sum(n - 1 for n in Counter(i for i, rating in rows if rating != RATINGS[3]).values())
    expected = dict(zip([name for name, _ in STEPS], [None, -excluded, -repeats, -len(kept - set(stored)), sum(s == "api" for i, s in stored.items() if i not in kept),
                        sum(s != "api" for i, s in stored.items() if i not in kept), -3, 0, -5], strict=True))
    found = shown.orderBy("step").collect()
    assert found[0].rows == len(rows) and found[0].change is None and found[-1].rows == passed[-1]
    assert {r.label: r.change for r in found} == {k: v for k, v in expected.items() if v or dict(STEPS)[k]}
    total = len(rows)
    for r in found[1:]:
        total += r.change
        assert r.rows == total
    assert refreshed == sum(stored.get(i) == "api" for i in kept)
    counted = snapshot_counts(spark.createDataFrame(rows, "mal_id long, rating string")).first()
    assert tuple(counted) == (len(rows), excluded, repeats, len(kept))


def test_a_store_that_the_sources_cannot_explain(spark):
    rows, _, stored = generated(21)
    with pytest.raises(ValueError, match=f"database has {len(stored) + 1}"):
        build_funnel(*tables(spark, rows, stored, (len(stored) + 1, 0, 0, 0)))


def test_empty_sources(spark):
    none = spark.createDataFrame([], "mal_id long, rating string")
    assert tuple(snapshot_counts(none).first()) == (0, 0, 0, 0)
