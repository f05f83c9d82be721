import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from titleworks.llm.encoder import Encoder
from titleworks.llm.lengths import at_limits, encoded_lengths, length_table, quantiles
from titleworks.llm.token_files import Reader, Writer, read_documents, write_token_files
from titleworks.llm.vocabulary import END_ID, VOCABULARY

ODD = "abcXYZ éÉßÄöÿ÷×'’.,!?;:|-_…  \t\n0123ΣςσİıǅﬁÅáéñ中文字🙂<>|  \x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("remembered", [50, 500_000])
def test_words_one_by_one_give_the_text_s_ids(library, remembered):
    random.seed(6)
    encoder = Encoder(VOCABULARY, remembered)
    for _ in range(3000):
        text = "".join(random.choice(ODD) for _ in range(random.randint(0, 20))) + random.choice(["", "'s", " it's.", "can't,", "!!", "..."])
        assert np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_with_the_strings_of_added_tokens(library):
    random.seed(7)
    encoder = Encoder(VOCABULARY)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "a", " b ", "\n", "É.", "<|", "|>"]
    for _ in range(1000):
        text = "".join(random.choices(parts, k=random.randint(1, 6)))
        assert np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_another_vocabulary_is_left_to_the_library():
    path = VOCABULARY.replace("word_bpe_49k", "byte_bpe_50k")
    encoder = Encoder(path)
    assert not encoder._folds and encoder.dtype.itemsize == 2


def test_files_and_back(spark, library, awkward):
    random.seed(9)
    rows = [(random.randrange(10**6) - 1000, " ".join(random.choices(["the", "Thing,", "été", "42", "x" * 70], k=random.choice([0, 3, 40, 3000])))) for _ in range(80)]
    docs = spark.createDataFrame([*rows, (None, "none"), (12, None), (12, "b"), (12, "a")], "doc_id long, text string").repartition(6)
    manifest = write_token_files(docs, VOCABULARY, END_ID, length=16)
    found = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in read_documents(manifest).collect()}
    start, stream = 0, []
    for doc_id, text in sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [END_ID]
        assert found[doc_id, start] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    files = manifest.orderBy("part").collect()
    assert sum(f.n_ids for f in files) == len(stream) and sum(f.n_docs for f in files) == len(found) == 84
    back = []
    for f in files:
        reader = Reader(f.path)
        for k in range(-(-f.n_ids // 16)):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 16
            back += ids[mask].tolist()
        reader.close()
    assert back == stream
    rows = read_documents(write_token_files(awkward, VOCABULARY, END_ID)).collect()
    assert len(rows) == 12 and sum(r.n_tokens == 1 for r in rows) == 4


def test_a_file_of_many_batches(tmp_path):
    writer = Writer(f"{tmp_path}/x", np.dtype("<u2"), 2, 8, 4)
    runs = [np.arange(n, dtype="<u2") for n in (0, 31, 1, 200, 7)]
    for k, ids in enumerate(runs):
        writer.add(k, ids.tobytes())
    writer.close()
    reader, start = Reader(writer.path), 0
    for ids in runs:
        assert np.concatenate(list(reader.run(start, len(ids) + 1))).tolist() == [*ids.tolist(), 2]
        start += len(ids) + 1
    assert reader.sequence(start // 8)[1].sum() == start % 8


def test_no_documents(spark, nothing):
    assert read_documents(write_token_files(nothing, VOCABULARY, END_ID)).count() == 0
    assert length_table(encoded_lengths(nothing, VOCABULARY)).count() == 0


def test_lengths_answer_every_limit(spark, library, awkward):
    random.seed(10)
    lengths = [random.choice([0, 1, 5, 5, 1023, 1024, 1025, 5000, random.randrange(9000)]) for _ in range(500)]
    table = length_table(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    for r in table.collect():
        n = r.n_tokens
        assert r.docs == lengths.count(n) and r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.docs_at_most == sum(x <= n for x in lengths) and r.tokens_at_most == sum(x for x in lengths if x <= n)
        assert r.tokens_cut == sum(min(x, n) for x in lengths)
    for r in at_limits(table, [0, 3, 1024, 10**6]).collect():
        assert (r.docs, r.docs_longer, r.tokens, r.tokens_cut) == (500, sum(x > r.context_limit for x in lengths), sum(lengths), sum(min(x, r.context_limit) for x in lengths))
    ordered = sorted(lengths)
    assert {r.share: r.n_tokens for r in quantiles(table, [0.01, 0.5, 1.0]).collect()} == {0.01: ordered[4], 0.5: ordered[249], 1.0: ordered[-1]}
    counted = {(r.doc_id, r.n_tokens) for r in encoded_lengths(awkward, VOCABULARY).collect()}
    assert {(2, 0), (3, 0), (8, len(library.encode("word", add_special_tokens=False).ids)), (None, 0)} <= counted
