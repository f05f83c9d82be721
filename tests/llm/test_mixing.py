import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from titleworks.llm.mixing import in_training_order, mix, sizes, sources_of, targets
from titleworks.llm.schedules import weighed


def planned(docs):
    entries = sizes(docs)
    return mix(entries, targets(weighed(sources_of(entries))))


def shared_out(source_sizes):
    """Targets by resharing one round at a time."""
    names = sorted(source_sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(source_sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * source_sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * source_sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_takes_and_positions(spark):
    random.seed(3)
    names = ["é", "z", "a", "B", None, "hot", "tiny"]
    rows = [(i, " ".join(["w"] * random.choice([1, 3, 10, 50, 200])), random.choice(names[:6] + ["hot"] * 4)) for i in range(900)]
    rows += [(5000, "one  two\x0bthree\x1cfour", "tiny"), (5001, None, "tiny"), (5002, "", "none at all"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plan = planned(docs).collect()
    source_sizes = defaultdict(int)
    for r in plan:
        source_sizes[r.source] += r.size * r.copies
    assert {r.size for r in plan if r.doc_id == 5000} == {3}
    expected = shared_out(source_sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in plan:
        assert r.source_size == source_sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.takes <= 2 and len(r.positions) == r.takes and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.takes * r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    for s, target in expected.items():
        assert abs(taken[s] - target) <= largest[s] / 2
    again = planned(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_small_documents_fill_what_a_long_one_leaves(spark):
    random.seed(11)
    rows = [(i, " ".join(["w"] * random.choice([1, 2, 5, 30, 400, 3000])), random.choice(["a", "b", "c", None, "hot", "hot"])) for i in range(240)]
    plan = planned(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    for s in {r.source for r in plan}:
        own = [r for r in plan if r.source == s]
        rounds = own[0].target // own[0].source_size
        left = [r.size for r in own if r.takes == rounds]
        assert abs(sum(r.takes * r.size for r in own) - own[0].target) <= min(left, default=0) / 2 + 1e-6
        due = sorted(p for r in own for p in r.positions)
        assert len(due) == len(set(due))


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w w w w", s) for s in "abc" for i in range(len("abc") * 400)]
    plan = planned(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    early = plan.select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg((F.col("p") < 0.5).cast("double")).alias("share"))
    shares = {r.source: r.share for r in early.collect()}
    # weights 4 to 2, 1, and 1 to 3: the first half holds 3.5 of 6, 1 of 2, and 1.5 of 4 of the words
    assert shares["a"] == pytest.approx(3.5 / 6, abs=0.02) and shares["b"] == pytest.approx(0.5, abs=0.02) and shares["c"] == pytest.approx(1.5 / 4, abs=0.02)


def test_training_order_repeats_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 5), "s", "extra") for i in range(60)] + [(None, "a b", None, "x")], "doc_id long, text string, source string, _id string")
    docs = docs.withColumnRenamed("_id", "other")
    plan = planned(docs)
    out = in_training_order(docs, plan).collect()
    takes = {(r.doc_id, r.source): r.takes for r in plan.collect()}
    assert len(out) == sum(takes.values()) and math.isclose(len(out), 90, abs_tol=25)
    assert all([(r.doc_id, r.source) for r in out].count(k) == n for k, n in takes.items())


def test_awkward_documents(awkward, nothing):
    assert sum(r.copies for r in planned(awkward).collect()) == 12
    assert planned(nothing).count() == 0
