"""A title's terms, counted as numbers for many titles at a time, agree with plain counting."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

from titleworks.operators import text_vectors as V


def plain(words: list[str]) -> Counter:
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def test_terms_are_counted_across_pieces(monkeypatch):
    pick = random.Random(5)
    lists = [[pick.choice(["a1", "b2", "été", "猫犬", "dd"]) for _ in range(n)] for n in (0, 1, 7, 40, 0, 3, 200, 2, 0)]
    ids = [3, None, 5, 5, 6, 7, 8, 9, 10]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.string()))], names=["mal_id", "words"])
    expected = Counter()
    for k, words in zip(ids, lists, strict=True):
        expected.update({(k, term, n): 1 for term, n in plain(words).items()})
    for size, cut in ((1, batch), (10, batch), (10**6, batch), (9, batch.slice(0, 9))):
        monkeypatch.setattr(V, "PIECE_WORDS", size)
        made = list(V._counted([cut]))
        assert Counter((r["mal_id"], r["term"], r["tf"]) for b in made for r in b.to_pylist()) == expected
    tail = Counter((r["mal_id"], r["term"], r["tf"]) for b in V._counted([batch.slice(2, 2)]) for r in b.to_pylist())
    assert sum(tail.values()) == sum(len(plain(words)) for words in lists[2:4])


def test_terms_need_no_lambda_for_each(spark):
    rows = [(1, "Deja vu, the cat: cat cat"), (2, None), (3, "the of"), (None, "Lone cat"), (4, "  ")]
    counts = V.term_counts(spark.createDataFrame(rows, "mal_id bigint, synopsis string"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan and "zip_with" not in plan
    found = Counter((r.mal_id, r.term, r.tf) for r in counts.collect())
    words = {1: ["deja", "vu", "cat", "cat", "cat"], None: ["lone", "cat"]}
    assert found == Counter({(k, term, n): 1 for k, own in words.items() for term, n in plain(own).items()})
