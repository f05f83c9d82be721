import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from titleworks.llm.text import flat, shingle_hashes, word_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b\x0c\r\x1c.!", max_size=30)), max_size=6)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_told_apart_and_counted(texts):
    hashes, at = word_hashes(*flat(pa.array(texts, pa.string())))
    expected = [words_of(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in expected]
    names = {}
    for word, h in zip([w for ws in expected for w in ws], hashes.tolist(), strict=True):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_shingles_of_each_text():
    texts = ["a b c d e", "a b", "", None, "c d e", "a b c d e f"]
    hashes, at = word_hashes(*flat(pa.array(texts)))
    shingles, to = shingle_hashes(hashes, at, 4)
    assert np.diff(to).tolist() == [2, 1, 0, 0, 1, 3]
    assert shingles[0] == shingles[4] and shingles[1] == shingles[5]
    assert len(set(shingles.tolist())) == 5


def test_a_sliced_column_and_a_giant_word():
    column = pa.array(["x", "big" * 700_000, "y z"]).slice(1)
    hashes, at = word_hashes(*flat(column))
    assert at.tolist() == [0, 1, 3]
    assert hashes[1] == word_hashes(*flat(pa.array(["y"])))[0][0]


def test_punctuation_behind_words_may_be_left_out():
    a, b = (word_hashes(*flat(pa.array([t])), bare=True)[0].tolist() for t in ("Thing, ÉTÉ× and (that)!", "thing été× and (that"))
    assert a == b
