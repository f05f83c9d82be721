import random
import re
from collections import Counter, defaultdict

from titleworks.llm import divergence as module
from titleworks.llm.divergence import divergence


def brute(table, least, ranks):
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in table:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {g for g, _ in count}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: c for (g, s), c in count.items() if g == lang}
        whole = sum(own.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        for s, c in own.items():
            pairs = sorted((-sum(abs(p(c, t) - p(d, t)) for t in kept), o.encode(), o) for o, d in own.items() if o != s)
            terms = sorted((p(whole, t) - p(c, t), t.encode(), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t))[:ranks]
            out += [(lang, s, part, x[2], -x[0], k) for part, rows in (("pair", pairs), ("term", terms)) for k, x in enumerate(rows, 1)]
    return sorted(out)


def table(n=300):
    random.seed(4)
    words = [f"{a}{b}" for a in ("ab", "Ba", "é", "中", "Ä", "x") for b in ("c", "D", "ß", "q")]
    rows = [(i, " ".join(random.choices(words[: random.randint(3, 24)], k=random.randint(0, 60))) + random.choice(["", ".", " 12_3", "-a"]), random.choice(["en", "de", None]), random.choice(["s1", "s2", "s3", "é", None, "S1"])) for i in range(n)]
    return [*rows, (n, None, "en", "bare"), (n, "", "lonely", "one"), (n, "rare words", "few", "a"), (n, "others", "few", "b"), (None, "abc " * 5000, "en", "s1")]


def test_all_parts_against_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    for least, ranks in ((30, 50), (2, 3)):
        assert sorted(tuple(r) for r in divergence(docs, least, ranks).collect()) == brute(rows, least, ranks)


def test_many_blocks_and_tiles(spark, monkeypatch):
    for name, value in (("BLOCK", 5), ("TILE", 2), ("HELD_TERMS", 20), ("_CELLS", 7)):
        monkeypatch.setattr(module, name, value)
    rows = table(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    assert sorted(tuple(r) for r in divergence(docs, 3, 50).collect()) == brute(rows, 3, 50)


def test_large_counts_stay_exact(spark):
    pair = spark.createDataFrame([(10**13, 10**13 + 7, 3)], "n bigint, total bigint, terms bigint")
    assert pair.select(module.share(pair["n"], pair["total"], pair["terms"])).first()[0] == 1 + 10**9 * (10**13 + 5) // (10**13 + 7 + 15)


def test_awkward_documents(awkward, nothing):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in awkward.collect()]
    assert sorted(tuple(r) for r in divergence(awkward, 2).collect()) == brute(rows, 2, 50)
    assert divergence(nothing).count() == 0
