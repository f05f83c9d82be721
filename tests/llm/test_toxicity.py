import random

import numpy as np
from pyspark.sql import functions as F

from titleworks.llm import toxicity
from titleworks.llm.text import remainder
from titleworks.llm.toxicity import Automaton, Scorer, _points, choose, words_of


def distances(word, term):
    """Edits from every beginning of word, the whole one last, to term."""
    row = list(range(len(term) + 1))
    out = [row[-1]]
    for i, c in enumerate(word, 1):
        row = _next(row, c, term, i)
        out.append(row[-1])
    return out


def _next(row, c, term, i):
    new = [i]
    for j, t in enumerate(term, 1):
        new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
    return new


def test_automaton_against_edit_distances():
    random.seed(5)
    terms = [("abcab", True, 1), ("bca", False, 1), ("aabbccaab", True, 2), ("cab", True, 0), ("ccbb", False, 0)]
    machine = Automaton(terms)
    words = ["".join(random.choices("abcd", k=random.randint(0, 11))) for _ in range(4000)]
    words += [w for t, _, _ in terms for w in (t, t + "d", t[1:], t[:-1], "d" + t, t[:2] + "d" + t[3:])]
    points, at = _points([w.encode() for w in words])
    found = machine.match(points, at[:-1], at[1:] - 1)
    for word, k in zip(words, found, strict=True):
        able = []
        for n, (term, whole, edits) in enumerate(terms):
            own = distances(word, term)
            e = own[-1] if whole else min(own)
            able += [(e, n)] if e <= edits else []
        assert (k >= 0) == bool(able) and (k < 0 or ((k % 4, k // 4) in able and k % 4 == min(able)[0])), word


def test_words_keep_marks_between_letters():
    text = "An id!ot, $tupid* a--b “Wörter” 中文 x@y.z"
    points, _ = _points([text.encode()])
    starts, ends = words_of(points)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(starts, ends, strict=True)] == ["an", "id!ot", "tupid", "a", "b", "wörter", "中文", "x@y", "z"]


def test_quotation_is_told_from_abuse():
    scorer = Scorer([("idiot", True, 5.0)])
    texts = ["You are an idiot you idiot", "The man is an idiot here", "The paper said the word idiot is rude", 'He read “idiot” aloud to the class', "x " * 30 + "“" + "y " * 30 + "idiot"]
    row, _, edits, abuse, words = scorer.matches([t.encode() for t in texts])
    assert list(row) == [0, 0, 1, 2, 3, 4] and not edits.any() and list(words[:2]) == [6, 6]
    assert abuse[2] == abuse[5] == 1 and abuse[0] == 1 and abuse[3] < 0.75 and abuse[4] < 0.4


def test_lexicon_takes_the_longest_of_equal_beginnings():
    found = choose([("vil", False, 40, 9), ("vile", False, 40, 0), ("vileness", True, 12, 0), ("villa", True, 3, 2), ("gross", True, 30, 0), ("gros", False, 30, 0), ("rare", True, 2, 0)], 1000, 50, 400)
    assert {(t, w) for t, w, _ in found} == {("vile", False), ("gross", True)}


def corpus(n=900):
    """Toxic texts have abusive words, some misspelled; clean ones some of the words in quotation marks."""
    random.seed(6)
    plain = ["".join(random.choices("aeioulnrst", k=random.randint(2, 8))) for _ in range(500)]
    bad = ["wretched", "villainous", "loathsome"]

    def spoilt(word):
        k = random.randrange(1, len(word))
        return random.choice([word[:k] + word[k + 1 :], word[:k] + "!" + word[k + 1 :], word[:k] + "e" + word[k:]])

    rows, labels = [], []
    for i in range(n):
        words, toxic = random.choices(plain, k=random.randint(20, 150)), i % 6 == 0
        at = random.sample(range(len(words)), 4)
        if toxic:
            for k in at:
                words[k] = random.choice(bad) if i % 12 else spoilt(random.choice(bad))
        elif i % 18 == 1:
            words[at[0]] = f"“{random.choice(bad)}”"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_texts_misspellings_and_quotations(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scorer = toxicity.train(docs, marks, remainder(F.col("doc_id"), 4) != 2)
    row, *_ = scorer.matches([b"wretched", b"villainous", b"loathsome", b"a villaqinous man", b"other words"])
    assert list(row) == [0, 1, 2, 3]
    found = toxicity.score(docs, scorer).where(remainder(F.col("doc_id"), 4) == 2).collect()
    right = [(r.toxic_score >= 0.3) == (r.doc_id % 6 == 0) for r in found]
    assert np.mean(right) > 0.97
    again = toxicity.train(docs.repartition(3), marks.repartition(2), remainder(F.col("doc_id"), 4) != 2)
    assert np.allclose(again.coefficients, scorer.coefficients) and again.automaton.terms == scorer.automaton.terms
    known = toxicity.train(docs, marks, remainder(F.col("doc_id"), 4) != 2, known_terms=["wretched", "ghastly"])
    assert [t for t, _, _ in known.automaton.terms].count("wretched") == 1 and ("ghastly", True, 1) in known.automaton.terms


def test_held_out_documents_of_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    from titleworks.llm.queries import QUERIES

    found = QUERIES["op13_toxicity"](spark, folder)
    known = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in known}
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0] and n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))


def test_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, 1), (7, 0), (8, None), (None, 1), (3, 7), (2, 0)], "doc_id bigint, toxic int")
    scorer = toxicity.train(awkward, labels, F.lit(True))
    found = toxicity.score(awkward, scorer)
    rows = found.collect()
    assert found.columns == [*awkward.columns, "toxic_score"] and len(rows) == 12 and all(0 <= r.toxic_score <= 1 for r in rows)
    assert len({r.toxic_score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(nothing, scorer).count() == 0
    assert "toxic_score" in toxicity.score(awkward.withColumn("toxic_score", F.lit("old")), scorer).columns
    ignorant = toxicity.train(nothing, labels.where("false"), F.lit(True))
    assert {r.toxic_score for r in toxicity.score(awkward, ignorant).collect()} == {0.5}
