import random

import numpy as np
from pyspark.sql import functions as F

from titleworks.llm import quality
from titleworks.llm.text import remainder


def corpus(spark, n):
    random.seed(n)
    words = ["river", "stone", "light", "walks", "under", "green", "early", "house", "letter", "window"]
    rows = []
    for i in range(n):
        text = [random.choice(words) + random.choice(words)[:2] for _ in range(random.randint(20, 80))]
        junk = i % 4 == 0
        if junk and i % 8:
            text = [w + random.choice(["!!", "%%", "##"]) for w in text]
        elif junk:
            text = text[:3] + text[3:4] * 40
        rows.append((i, " ".join(text), int(not junk)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy(spark):
    rows = corpus(spark, 1800)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels, ~held_out)
    scored = quality.score(docs, model).join(labels, "doc_id").withColumn("held_out", held_out)
    right = scored.where("held_out").agg(F.avg(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    other = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(docs, other, ~held_out).vectors, model.vectors)  # held-out labels are not read


def test_scores_are_the_softmax_of_the_average(spark):
    rows = corpus(spark, 60)
    model = quality.train(rows, rows.select("doc_id", "quality"), F.lit(True))
    got = {r.doc_id: r.quality_score for r in quality.score(rows.select("doc_id", "text"), model).collect()}
    for r in quality._bags(rows.select("doc_id", F.col("quality").alias("label"), "text")).collect():
        average = np.frombuffer(r.shares, np.float32) @ model.vectors[np.frombuffer(r.places, np.int32)]
        out = np.exp(model.weights @ average + model.bias)
        assert abs(out[1] / out.sum() - got[r.doc_id]) < 1e-4


def test_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (9, 7), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    model = quality.train(awkward, labels, F.lit(True))
    rows = quality.score(awkward, model).collect()
    assert len(rows) == 12 and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id in (2, 3)}) == 1
    assert len({r.quality_score for r in rows if r.doc_id in (1, 7)}) == 1
    assert quality.score(nothing, model).count() == 0
    unknown = quality.train(nothing, labels.limit(0), F.lit(True))
    assert {r.quality_score for r in quality.score(spark.createDataFrame([(1, None)], "doc_id long, text string"), unknown).collect()} == {0.5}


def plain_grams(text, size):
    """n-grams of characters inside words, "_" for a word's boundary, without those of boundaries alone."""
    out = []
    for word in text.replace("\t", " ").replace("\n", " ").split(" "):
        padded = f"\0{word}\0"
        if word:
            out += [padded[i : i + size] for i in range(len(padded) - size + 1) if padded[i : i + size].strip("\0")]
    return out


def test_grams_of_characters_against_plain_ones():
    random.seed(4)
    letters = "ab é漢😀 \t\n "
    texts = ["", " ", "a", "é", "漢字 ab", "  x  ", *("".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(200))]
    column = quality.pa.array([*texts, None])
    data, at = quality.flat(column)
    for size, (places, to) in zip(quality.GRAMS, quality._grams(data, at), strict=True):
        number = {}
        for i, text in enumerate([*texts, ""]):
            own, expected = places[to[i] : to[i + 1]].tolist(), plain_grams(text, size)
            assert len(own) == len(expected)
            assert all(number.setdefault(gram, place) == place for gram, place in zip(expected, own, strict=True))
        assert len(set(number.values())) >= 0.97 * len(number)  # few share a place
    assert [len(p) for p, _ in quality._grams(*quality.flat(quality.pa.array([], quality.pa.string())))] == [0] * len(quality.GRAMS)


def test_the_sample_is_fitted_in_a_task_and_not_brought_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"bad {i} bad") for i in range(20)], "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    bags = quality._bags(docs.join(labels.withColumnRenamed("quality", "label"), "doc_id")).orderBy("doc_id").collect()
    wanted = quality.Model().fit([(np.frombuffer(r.places, np.int32), np.frombuffer(r.shares, np.float32)) for r in bags], np.array([r.label for r in bags]))

    def refused(self):
        raise AssertionError("brought to the driver")

    monkeypatch.setattr(type(docs), "toArrow", refused)
    weights, bias = quality.train(docs, labels, F.lit(True)).pull()
    assert np.allclose(weights, wanted.pull()[0], atol=1e-5) and abs(bias - wanted.pull()[1]) < 1e-5
