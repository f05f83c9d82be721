import random
import re

import numpy as np
import pytest

from titleworks.llm.licences import CONFIRMED, NOT_NONE, TEMPLATES, licences, train


def test_lines_of_licences_and_of_other_text(spark, awkward, nothing):
    random.seed(4)
    prose = lambda: " ".join("".join(random.choices("abcdefghi", k=random.randint(2, 8))) for _ in range(random.randint(1, 25))).capitalize() + "."
    named = {"Released under the MIT License.": "mit", "licensed under the APACHE license, version 2.0": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "This file is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    rows, expected = [], set()
    for i in range(300):
        lines = [prose() for _ in range(random.randint(1, 6))]
        if i % 5 == 0:
            text = random.choice(list(named))
            at = random.randrange(len(lines) + 1)
            lines.insert(at, text)
            expected.add((i, at, named[text]))
        rows.append((i, "\n".join(lines)))
    rows += [(900, "His driving license was in the public library."), (901, "The version of the work that he was granted is free of charge.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classifier = train(docs)
    found = licences(docs, classifier).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in found if r.confirmed} == expected
    assert sum(not r.confirmed for r in found) <= 3
    families = {t: f for f, t in TEMPLATES if f != "none"}
    own = spark.createDataFrame(list(enumerate(families)), "doc_id long, text string")
    right = sum(r.confirmed and r.family == list(families.values())[r.doc_id] for r in licences(own, classifier).collect())
    assert right >= len(families) - 2
    assert licences(awkward, classifier).count() == 0 and licences(nothing, classifier).count() == 0
    assert 0.3 <= train(nothing).limit <= 0.9


def _trained(spark):
    random.seed(9)
    prose = [(i, " ".join("".join(random.choices("abcdefghi", k=random.randint(2, 8))) for _ in range(12)) + ".") for i in range(200)]
    return train(spark.createDataFrame(prose, "doc_id long, text string"))


def test_wrapped_notices_and_notices_inside_long_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met."
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."
    cc0 = "To the extent possible under law, the author has waived all\r\ncopyright and related rights to this work under CC0 1.0."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    fill = " ".join(f"zq{i % 7}x" for i in range(200))
    rows = [(1, bsd), (2, gpl), (3, cc0), (4, f"{fill} {mit} {fill}"), (5, f"first line\n\n{bsd}\n\nlast line"), (6, bsd.replace("\n", "\n\n")),
            (None, mit), (7, bsd), (7, bsd), (8, f"{mit}\nabc\n{mit}"), (9, f"{bsd}\n\nRedistribution\n{fill}"), (10, (fill + " ") * 500 + mit + " " + fill * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS lines", "2 AS paragraph", "3 AS rows", "4 AS at").repartition(3)
    got = sorted(((r.doc_id or 0, r.paragraph, r.family) for r in licences(docs, _trained(spark)).where("confirmed").collect()))
    assert got == sorted([(0, 0, "mit"), (1, 0, "bsd"), (2, 0, "gpl-3.0"), (3, 0, "cc0"), (4, 0, "mit"), (5, 2, "bsd"), (7, 0, "bsd"), (7, 0, "bsd"),
                          (8, 0, "mit"), (8, 2, "mit"), (9, 0, "bsd"), (10, 0, "mit")])


def test_scores_agree_with_plain_python(spark):
    classifier = _trained(spark)
    random.seed(12)
    pieces = [w for _, t in TEMPLATES for w in t.split()]
    texts = [" ".join(random.choice(TEMPLATES)[1].split()[random.randint(0, 3) :]) if random.random() < 0.5 else " ".join(random.choices(pieces, k=random.randint(1, 40))) for _ in range(300)]
    found = {r.doc_id: r for r in licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), classifier).collect()}
    none = classifier.families.index("none")
    templates = [(f, {tuple(p) for p in zip(_plain(t), _plain(t)[1:], strict=False)}) for f, t in TEMPLATES if f != "none"]
    for i, text in enumerate(texts):
        words = _plain(text)
        pairs = set(zip(words, words[1:], strict=False))
        logits = np.array(classifier.constants)
        for term in set(words) | {" ".join(p) for p in pairs}:
            logits = logits + np.array(classifier.weights.get(term, [0.0] * len(logits)))
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = max((p[k], f) for k, f in enumerate(classifier.families) if k != none)
        shares = [(len(own & pairs) / len(own), f) for f, own in templates]
        own_share = max([s for s, f in shares if f == best[1]]) if p[none] < NOT_NONE and best[0] >= classifier.limit else 0.0
        if own_share >= CONFIRMED:
            expected = (best[1], own_share)
        elif max(shares)[0] >= CONFIRMED:
            expected = (max(shares)[1], max(shares)[0])
        elif p[none] < NOT_NONE:
            expected = (best[1] if best[0] >= classifier.limit else "unknown", own_share)
        else:
            expected = None
        if expected is None:
            assert i not in found
        else:
            assert found[i].family == expected[0] and found[i].template_share == pytest.approx(expected[1])
            assert found[i].probability == pytest.approx(p[classifier.families.index(expected[0])] if expected[0] != "unknown" else best[0])


def _plain(text):
    return [w for w in (w.strip(".+-") for w in re.split(r"[^a-z0-9.+-]+", text.lower())) if w]
