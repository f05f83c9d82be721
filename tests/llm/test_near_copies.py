import random

import numpy as np

from titleworks.llm.components import components
from titleworks.llm import components as component_module
from titleworks.llm import near_copies as module
from titleworks.llm.near_copies import REGISTERS, SLACK, estimate, fine_estimate, forest, near_copies, odd_sketch, registers
from titleworks.session import settle


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and root(j) == root(i) and rows[j][0] is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def test_links_against_all_pairs(spark):
    random.seed(8)
    word = lambda: random.choice("abcdefghijklmnop") + random.choice("qrstuvwxyz")
    shared = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(150)]
    for i in range(140):  # a group whose members are near the limit of each other
        text = list(base)
        for _ in range(random.randint(0, 9)):
            text[random.randrange(len(text))] = word() + "x"
        rows.append((1000 - i, " ".join(text)))
    for i in range(60):  # documents that share a passage
        rows.append((2000 + i, " ".join([word() for _ in range(random.randint(5, 60))] + shared)))
    for i in range(40):  # chains: each drops some words of the one before
        chain = [f"c{i // 8}w{j}" for j in range(4 * (i % 8), 4 * (i % 8) + 60)]
        rows.append((3000 + i, " ".join(chain)))
    rows += [(5000 + i, " ".join(f"s{j}" for j in range(i % 6 + 1))) for i in range(30)]
    rows += [(7, None), (8, ""), (9, " \n"), (6000, rows[0][1].upper()), (6000, rows[0][1].upper()), (None, rows[200][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k in (4, 5):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_copies(docs, k).collect()), key=repr)
        assert got == brute(rows, k)


def test_awkward_documents(spark, awkward, nothing):
    rows = near_copies(awkward).collect()
    assert len(rows) == 12
    assert {(r.doc_id, r.component_id) for r in rows if r.n_shingles == 2} == {(1, 1), (7, 1), (None, 1)}
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles > 1000} == {(5, 5, True), (6, 5, False)}
    assert all(r.kept for r in rows if r.n_shingles == 0)
    assert near_copies(nothing).count() == 0


def test_estimates_of_small_and_large_sets():
    random_ = np.random.default_rng(5)
    low = 0.8 - SLACK * np.sqrt(0.16 / REGISTERS)
    for n in (4, 5, 8, 20, 96, 400):
        both = [(np.unique(u[:n]), np.unique(u)) for u in random_.integers(0, 1 << 64, (100, n + n // 4), dtype=np.uint64)]
        a, b = (registers([p[k] for p in both]) for k in (0, 1))
        e = estimate(a, b, np.full(100, n), np.full(100, n + n // 4))
        assert (e >= low).all() and abs(e.mean() - n / (n + n // 4)) < 0.02
        assert (a.view("<u8") == b.view("<u8")).any(axis=1).all()


def test_fine_estimates_at_the_limit_stay_within_the_slack():
    random_ = np.random.default_rng(3)
    for n in (18, 99, 702, 2502, 30_006):
        common = 8 * n // 9  # two sets of n with Jaccard similarity 0.8
        a, b = [], []
        for _ in range(150):
            h = random_.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
            a.append(np.sort(h[:n]))
            b.append(np.sort(h[n - common :]))
        true = common / (2 * n - common)
        sides = [np.frombuffer(b"".join(odd_sketch(s) for s in x), np.uint64).reshape(len(x), -1) for x in (a, b)]
        found, error = (np.diag(m) for m in fine_estimate(*sides))
        assert abs(found.mean() - true) < 0.006 and found.std() < 1.2 * error.mean() + 1e-9 and (found > true - SLACK * error - 1e-6).all(), (n, found.std(), error.mean())


def test_forests_link_what_all_pairs_link():
    random_ = np.random.default_rng(4)
    for _ in range(50):
        n, m = 30, int(random_.integers(0, 80))
        x, y = random_.integers(0, n, (2, m))
        part = random_.integers(0, n, n)
        keep = part[x] != part[y]
        x, y = x[keep], y[keep]
        chosen = forest(x, y, random_.random(len(x)).round(1), part)

        def reach(edges, part=part, x=x, y=y):
            label = part.copy()
            for _ in range(n):
                for k in edges:
                    low = min(label[x[k]], label[y[k]])
                    label[(label == label[x[k]]) | (label == label[y[k]])] = low
            return label

        assert (reach(chosen) == reach(range(len(x)))).all() and len(chosen) <= max(len(set(part)) - 1, 0)


def test_many_rounds_give_the_links_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "SLACK", 12.0)  # many candidates are refused
    monkeypatch.setattr(component_module, "ONE_TASK", 0)
    random.seed(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(random.randint(2, 14)):
            text[random.randrange(len(text))] = f"x{random.random()}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_copies(docs, 4).collect()), key=repr) == brute(rows, 4)


def test_a_large_group_of_unlinked_candidates_makes_no_row_for_each_pair(spark, monkeypatch):
    made = {}

    def counted(df, name="settled"):
        out = settle(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(module, "settle", counted)
    monkeypatch.setattr(module, "SLACK", 24.0)  # every pair that shares a band is a candidate
    random.seed(10)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):  # pairs are below the limit
        text = list(base)
        for at in random.sample(range(120), 3):
            text[at] = f"x{i}at{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_copies(docs, 4).collect()), key=repr) == brute(rows, 4)
    assert max(made.values()) <= 2 * made["shared-bands"] < 160 * 159 / 2 and made["likely"] > 1000


def test_components_of_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(component_module, "ONE_TASK", 0)
    chains_and_hubs(spark)
    monkeypatch.setattr(component_module, "ONE_TASK", 1 << 20)
    chains_and_hubs(spark)


def chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    hub = [(i, 500) for i in range(300, 400)]
    links = spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 300 for i in [*range(300, 400), 500]}
    assert components(links.limit(0)).count() == 0
