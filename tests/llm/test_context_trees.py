import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleworks.llm import context_trees
from titleworks.llm.context_trees import DEPTH, Model, score


def kt(bits):
    """Krichevsky-Trofimov probability of a run of bits."""
    n, p = [0, 0], 1.0
    for b in bits:
        p *= (n[b] + 0.5) / (n[0] + n[1] + 1)
        n[b] += 1
    return p


def tree_chances(seen, contexts, node_bits, path):
    """The weighted chance that the next bit is 1 at a context path, by the definition; seen: (context, bit) of a binary node."""

    def own(prefix, d):
        return [b for c, b in seen if c[:d] == prefix]

    def weighted(prefix, d):
        bits = own(prefix, d)
        if d == DEPTH:
            return kt(bits)
        longer = [c for c in contexts if len(c) == d + 1 and c[:d] == prefix]
        rest = [b for c, b in seen if c[:d] == prefix and c[: d + 1] not in longer]
        return 0.5 * kt(bits) + 0.5 * math.prod([weighted(c, d + 1) for c in longer] + [kt(rest)])

    def chance(bits):
        return (sum(bits) + 0.5) / (len(bits) + 1)

    def mixture(prefix, d):
        bits = own(prefix, d)
        if d == DEPTH:
            return chance(bits)
        stop = 0.5 * kt(bits) / weighted(prefix, d)
        further = path[: d + 1]
        if further in contexts:
            return stop * chance(bits) + (1 - stop) * mixture(further, d + 1)
        rest = [b for c, b in seen if c[:d] == prefix and c[: d + 1] not in contexts]
        return stop * chance(bits) + (1 - stop) * chance(rest)

    return mixture((), 0)


def test_probabilities_by_the_definition():
    random.seed(5)
    seen = [(tuple(random.choice([0, 97, 98]) for _ in range(DEPTH)), random.choice([97, 98, 0, 200])) for _ in range(25)]
    contexts = {c[:d] for c, _ in seen for d in range(DEPTH + 1) if sum(x[:d] == c[:d] for x, _ in seen) >= 3}
    code = lambda c: sum(b << 8 * k for k, b in enumerate(c))
    rows = Counter((d, code(c[:d]), byte) for c, byte in seen for d in range(DEPTH + 1) if c[:d] in contexts)
    depth, context, byte, n = (np.array(x) for x in zip(*[(*k, v) for k, v in rows.items()], strict=True))
    model = Model(depth, context, byte, n)
    for path in random.sample([c for c, _ in seen], 3) + [(1,) * DEPTH]:
        node, d = 0, 0
        while d < DEPTH and model.child[node, path[d]]:
            node, d = model.child[node, path[d]], d + 1
        for symbol in (97, 98, 5):
            expected = 1.0
            for level in range(8):
                high = symbol >> (8 - level)
                bits = [(c, b >> (7 - level) & 1) for c, b in seen if b >> (8 - level) == high]
                p = tree_chances(bits, contexts, None, path)
                expected *= p if symbol >> (7 - level) & 1 else 1 - p
            assert model.log[node, symbol] == pytest.approx(math.log10(expected), abs=1e-4)
    assert np.allclose((10.0 ** model.log.astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def test_base_and_scores_of_a_corpus(spark, monkeypatch):
    random.seed(7)
    words = ["tion", "The", "ing", "ment", "over"]
    rows = [(i, " ".join("".join(random.choices(words, k=random.randint(1, 3))) for _ in range(random.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "the end"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    training = F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False))
    known, texts = Counter(), 0
    for i, text in rows:
        if i is not None and i % 5 != 2:
            known.update(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))
            texts += 1
    total, distinct = sum(known.values()) + texts, len(known) + 1
    for held in (1 << 18, 8):  # with few held words most counts are joined
        got = score(docs, training, words=held).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(t for i, t in rows if i == r.doc_id) or ""
            own = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
            base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*[known[w] for w in own], texts])
            assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(w in known for w in own) + 1, total)
            assert r.score < 0
        out = [r for r in got if not r.training and r.n_bytes > 20]
        assert -sum(r.score for r in out) * math.log2(10) < 3 * sum(r.n_bytes for r in out)  # under 3 bits a byte
    monkeypatch.setattr(context_trees, "_HELD", 100)
    assert sorted(map(str, score(docs, training).collect())) == sorted(map(str, score(docs, training).collect()))


def test_all_contexts_seen_often_enough_have_nodes(spark):
    random.seed(9)
    texts = ["".join(random.choices("abcdefghijklmnopé ", k=400)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for least in (1, 3):
        seen = Counter()
        for text in texts[:50]:
            data = b"\0" * DEPTH + text.encode() + b"\0"
            for i in range(DEPTH, len(data)):
                seen.update((d, sum(data[i - k - 1] << 8 * k for k in range(d)), data[i]) for d in range(DEPTH + 1))
        often = Counter()
        for (d, context, _), n in seen.items():
            often[d, context] += n
        rows = [(*k, n) for k, n in seen.items() if often[k[:2]] >= least]
        assert least > 1 or max(Counter(d for d, _ in often).values()) > 8192
        model = Model(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
        for codes in (1 << 20, 50):  # with few held codes most are joined
            got = {r.doc_id: r.score for r in score(docs, F.col("doc_id") < 50, least=least, codes=codes).collect()}
            for i, text in enumerate(texts):
                data = text.encode()
                assert got[i] == pytest.approx(model.scores(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0], rel=1e-4)


def test_awkward_documents(awkward, nothing):
    rows = score(awkward, F.lit(True)).collect()
    assert len(rows) == 12 and sum(r.n_tokens == 1 for r in rows) == 4
    assert len({round(r.score, 6) for r in rows if r.n_bytes == 0}) == 1
    assert score(nothing, F.lit(True)).count() == 0
    untrained = score(awkward, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(-(r.n_bytes + 1) * math.log10(256), rel=1e-4) for r in untrained)
