import random
import re
from itertools import permutations

from titleworks.llm.filter_audit import FILTERS, filter_audit


def fails(doc_id, text, table):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    return out | ({"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in table) else set())


def brute(table, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    known = [(lang or "", i, fails(i, t, table)) for i, t, lang in table]
    out = []
    for part in {p for p, _, _ in known}:
        rows = [(i, f) for p, i, f in known if p == part]
        first = {f: sum(120 // len(x) for _, x in rows if f in x) for f in FILTERS}
        for order in permutations(FILTERS):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                failing = [x for _, x in rows if f in x]
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(x == {f} for x in failing),
                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), first[f]))
    return sorted(out)


def test_every_order_against_brute_force(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.sample(words, 250)), " ".join(random.choices(words[:9], k=230)), "Short TEXT", "no capitals | here", "", None, " \t\n", "é" * 300, " ".join(random.sample(words, 240)) + " #",
             " ".join(w.upper() for w in random.sample(words, 220)), "x " * 250, "a\x1cb " * 210]
    table = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(400)]
    table += [(7, texts[0], "en"), (7, texts[0], "de"), (7, "another", "en"), (None, texts[0], "en"), (None, texts[0], "en"), (-5, texts[2], "fr")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 400, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(5)
    found = filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in found) == brute(table, labels)


def test_copies_dealt_to_several_tasks_and_shuffled_hashes(spark, monkeypatch):
    from titleworks.llm import filter_audit as module

    monkeypatch.setattr(module, "COPIES_A_TASK", 10)
    monkeypatch.setattr(module, "BROADCAST_HASHES", 0)
    table = [(i, "same text" if i % 3 else f"own {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(7)
    found = filter_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.kept, r.removed, r.shapley) for r in found] == [(101, 199, sum(120 // len(fails(i, t, table)) for i, t, _ in table if "E" in fails(i, t, table)))]


def test_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = filter_audit(awkward, labels).collect()
    table = [(r.doc_id, r.text, r.lang) for r in awkward.collect()]
    assert sorted(tuple(r) for r in rows) == brute(table, [(1, 1, 0)])
    assert filter_audit(nothing, labels).count() == 0
    assert filter_audit(awkward, labels.where("false")).agg({"good_lost": "sum"}).first()[0] == 0
