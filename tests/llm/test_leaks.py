import random

import numpy as np
from pyspark.sql import functions as F

from titleworks.llm import leaks
from titleworks.llm.leaks import common_subsequence, find_leaks, overlapping, passages_of


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[j], old[j + 1]))
    return row[-1]


def test_common_subsequences_against_the_table():
    random.seed(1)
    for _ in range(300):
        a, b = ([random.randrange(6) for _ in range(random.randint(1, 90))] for _ in range(2))
        places = {}
        for k, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << k
        assert common_subsequence(places, len(a), b) == longest(a, b)


def prose(n):
    common = ["the", "of", "and", "to", "in", "it"]
    return [random.choice(common) if random.random() < 0.4 else "".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_left(spark, monkeypatch):
    random.seed(12)
    monkeypatch.setattr(leaks, "SPACE", 25)  # several spaces
    items = [prose(random.randint(14, 59)) for _ in range(60)] + [prose(150), ["short", "five", "word", "item", "here"], ["tiny"]]
    rows, expected = [], set()
    for i in range(600):
        text = prose(random.choice([10, 60, 300, 2000]))
        if i % 3 == 0:
            k = i // 3 % len(items)
            passage, at = list(items[k]), random.randrange(len(text))
            if i % 2:
                passage = [w.capitalize() + random.choice(["", ",", "."]) for w in passage]
            if i % 9 == 0 and len(passage) >= 14:  # retold: some words out, the answer kept
                for _ in range(len(passage) // 8):
                    passage[random.randrange(len(passage) - 8)] = "other" + str(i)
            text[at:at] = passage
            expected.add((i, k))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, x.item_id) for r in find_leaks(docs, benchmark).collect() for x in r.leaks}
    assert found == expected


def test_awkward_documents(spark, awkward, nothing):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six"), (4, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13"), (4, "word")], "item_id long, text string")
    rows = find_leaks(awkward, benchmark).collect()
    assert len(rows) == 12 and set(rows[0].asDict()) == set(awkward.columns)
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in rows if r.text}
    assert {k: v for k, v in found.items() if k not in (3, 4)} == {1: [None], 7: [None], None: [None], 5: [4], 6: [4], 8: [4], 9: []}
    assert all(r.leaks == [] for r in rows if not r.text)
    assert find_leaks(nothing, benchmark).count() == 0
    assert all(r.leaks == [] for r in find_leaks(awkward, benchmark.limit(0)).collect())


def test_a_long_item_is_several_passages():
    found = passages_of([(3, " ".join(f"w{i}" for i in range(130))), (4, None), (5, "a b")])
    assert [(i, len(w)) for i, w in found] == [(3, 44), (3, 43), (3, 43), (5, 2)]


def test_copies_are_found_whatever_their_words_weigh(spark):
    random.seed(21)
    common = ["the", "of", "and", "to", "in", "it", "is", "was", "for", "on"]
    ordinary = [[random.choice(common) for _ in range(n)] for n in (8, 11, 14, 20)]
    hot = [["hot", *prose(18)], ["warm", *prose(33)]]
    items = ordinary + hot + [prose(30) for _ in range(40)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for n in (200, 2000):
        rows, expected = [], set()
        for i in range(n):
            text = ["".join(random.choices("klmnopqrst", k=6)) if random.random() < 0.6 else random.choice(common) for _ in range(90)]
            k = len(ordinary) + i // 3 % len(hot) if i % 3 == 0 else i % len(ordinary) if i % 10 == 1 else None
            if k is not None:
                at = random.randrange(len(text))
                text[at:at] = items[k]
                expected.add((i, k))
            rows.append((i, " ".join(text)))
        found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), benchmark).collect()
        assert {(r.doc_id, x.item_id) for r in found for x in r.leaks} >= expected
        assert all(x.cosine > 0 for r in found for x in r.leaks)


def test_copies_across_the_cuts_of_long_items(spark):
    random.seed(22)
    items = [[f"{a}{k}" for k, a in enumerate(prose(n))] for n in (64, 128, 128, 300)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    copies = [(0, 0, 51), (0, 13, 64), (1, 33, 115)]
    copies += [(3, cut - before, cut - before + 82) for cut in (60, 120, 180, 240) for before in (10, 31, 41, 60)]
    copies += [(2, at, at + 50) for at in range(0, 79, 6)]
    edited = [(3, at, at + 82) for at in range(5, 210, 13)]
    rows = []
    for i, (k, low, high) in enumerate(copies + edited):
        words = items[k][low:high]
        if i >= len(copies):
            words = [w if j % 12 else f"other{j}" for j, w in enumerate(words)]
        rows.append((i, " ".join([*prose(20), *words, *prose(100)])))
    rows += [(1000 + k, " ".join([*prose(20), *w[10:30], *prose(100), *w[40:55], *prose(50)])) for k, w in enumerate(items)]
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), benchmark).collect()
    assert {(r.doc_id, x.item_id) for r in found for x in r.leaks} == {(i, k) for i, (k, _, _) in enumerate(copies + edited)}
    assert all(0 < x.common <= x.words for r in found for x in r.leaks)


def test_blocks_are_bounded_by_passages(spark, monkeypatch):
    lengths = [0, 1, 7, 8, 63, 64, 65, 66, 128, 129, 700, 2000]
    items = [(k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate(lengths)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    made = {r.item_id: r.n for r in benchmark.select("item_id", leaks._passage_count(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).collect()}
    assert made == {i: len(overlapping([(i, t)])) for i, t in items}
    monkeypatch.setattr(leaks, "PASSAGES", 100)
    held = []
    monkeypatch.setattr(leaks, "_search", lambda docs, spaces, search=leaks._search: held.append(sum(len(s.words) for s in spaces)) or search(docs, spaces))
    docs = spark.createDataFrame([(i, "a b " + t[:400] + " c") for i, t in items], "doc_id long, text string")
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in find_leaks(docs, benchmark).collect()}
    assert len(held) > 1 and sum(held) == sum(made.values())
    assert all(found[i] == [i] for i, t in items if t)


def latent_space(spark, items, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    own = leaks.Passages(overlapping([(k, " ".join(w)) for k, w in enumerate(items)]))
    leaks._frequencies(docs, [own])
    own.place(leaks._directions(spark, own))
    return own


def topical(topics):
    """A passage of three words in four of two topics, so that passages share directions."""
    some = random.sample(topics, 2)
    return [random.choice(random.choice(some)) if random.random() < 0.75 else "".join(random.choices("abcdefghij", k=6)) for _ in range(random.randint(20, 50))]


def test_the_latent_space_finds_what_all_cosines_find(spark):
    random.seed(31)
    topics = [["".join(random.choices("klmnopqrst", k=5)) for _ in range(60)] for _ in range(12)]
    items = [topical(topics) for _ in range(150)]
    texts, parts = [], []
    for i in range(1500):
        text = prose(random.choice([40, 120]))
        if i % 2:
            k = random.randrange(len(items))
            part = [w for w in items[k] if random.random() < 0.8]  # words out here and there
            at = random.randrange(len(text))
            text[at:at] = part
            parts.append((i, k))
        texts.append(text)
    own = latent_space(spark, items, texts)
    assert own.pull.shape[1] == 75 < len(items) / 1.9
    data, at = leaks.flat(leaks.pa.array([" ".join(t) for t in texts]))
    hashes, rows = leaks.word_hashes(data, at, bare=True)
    found = {(r, k) for r, _, k, _ in leaks._windows(hashes, rows, own)}
    term, passages = own.term_of(hashes), own.rows()
    passages /= np.linalg.norm(passages, axis=1)[:, None]
    dense = set()
    for r in range(len(texts)):
        for start in range(rows[r], max(rows[r] + 1, rows[r + 1] - leaks.WINDOW + leaks.STRIDE), leaks.STRIDE):
            window = term[start : min(start + leaks.WINDOW, rows[r + 1])]
            vector = np.zeros(len(own.terms))
            np.add.at(vector, window[window >= 0], own.idf[window[window >= 0]])
            full = (own.idf[window[window >= 0]] ** 2).sum() + (window < 0).sum() * own.other**2
            dense |= {(r, int(k)) for k in np.flatnonzero(passages @ vector / np.sqrt(max(full, 1e-9)) >= 0.5)}
    assert len(dense) > 700 and len(dense & found) >= 0.97 * len(dense)
    assert sum(p in found for p in parts) >= 0.97 * len(parts)


def test_a_paraphrase_that_only_the_latent_space_finds(spark, monkeypatch):
    random.seed(32)
    items = [["".join(random.choices("abcdefghij", k=7)) for _ in range(random.randint(24, 40))] for _ in range(60)]
    rows, expected = [], set()
    for i in range(240):
        text = ["".join(random.choices("klmnopqrst", k=6)) for _ in range(80)]
        if i % 4 == 0:
            k = i // 4 % len(items)
            n = len(items[k])
            retold = [w if (n - 1 - j) % 5 != 2 else f"other{j}" for j, w in enumerate(items[k])]  # no run of RUN words is left
            retold = [w for j, w in enumerate(retold) if j % 13 != 5 or j >= n - 10]
            at = random.randrange(len(text))
            text[at:at] = retold
            expected.add((i, k))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    pairs = lambda: {(r.doc_id, x.item_id) for r in find_leaks(docs, benchmark).collect() for x in r.leaks}
    assert pairs() == expected
    monkeypatch.setattr(leaks, "_windows", lambda hashes, rows, own: iter(()))
    assert pairs() == set()
