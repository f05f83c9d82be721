import hashlib
import random
import re

from titleworks.llm.exact_copies import Trie, exact_copies


def brute(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for doc_id, text in rows:
        group = [(i, t) for i, t in rows if key(t) == key(text)]
        keep = min(group, key=lambda g: (-len(g[1] or ""), g[0] is None, g[0] or 0))[0]
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(key(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_copies_against_brute_force(spark):
    random.seed(2)
    rows = [(i, random.choice(["ab c", "a b c", "abc", "abcd", "é\tx", "éx", "", None, " ", "long " * 5000])) for i in range(300)]
    rows += [(None, "only"), (None, "on ly"), (5, "ab c"), (None, "abc      "), (400, "abd"), (401, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows)
    for held in (1 << 25, 200):  # with a small memory, subtrees are given away all the time
        assert sorted((tuple(r) for r in exact_copies(docs, held).collect()), key=repr) == expected


def test_awkward_documents(awkward, nothing):
    rows = exact_copies(awkward).collect()
    assert len(rows) == 12
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id in (2, 3, 4)} == {(4, 4)}
    assert {r.keep_id for r in rows if r.doc_id in (1, 7)} == {None}  # the copy with more characters has no id
    assert exact_copies(nothing).count() == 0


def test_trie_keeps_every_key():
    random.seed(1)
    keys = [bytes(random.choices(b"ab", k=random.randint(0, 9))) for _ in range(500)]
    trie, found = Trie(), {}
    for i, key in enumerate(keys):
        trie.insert(key, (len(key), i), 1)
        if i % 50 == 49:
            for k, owner, n in trie.spill():
                old = found.get(k, (owner, 0))
                found[k] = (min(old[0], owner, key=lambda o: o[1]), old[1] + n)
    for k, owner, n in trie.all():
        old = found.get(k, (owner, 0))
        found[k] = (min(old[0], owner, key=lambda o: o[1]), old[1] + n)
    assert {k: (o[1], n) for k, (o, n) in found.items()} == {k: (keys.index(k), keys.count(k)) for k in keys}
