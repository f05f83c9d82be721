"""Benchmark passages in documents, by latent semantic retrieval and a check of the words' order.

Benchmark passages are TF-IDF vectors, with document frequencies over all passages of the corpus. A
distributed randomised SVD of their matrix gives a latent space; every window of every document is
projected into it, and windows whose cosine with a passage is high are candidates. So are, whatever their
words weigh, places that have a run of RUN words with a passage in common. A candidate is a
leak if the longest common subsequence of its words with the passage's is long, or, for a paraphrase,
fair and holds the passage's answer, its last words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import flat, mixed, pieces, word_count, word_hashes

SPACE = 2000  # passages of one latent space at most: a whole block's
RANK = 128  # of it at most; half as many as its passages where those are few
SPARE = 8  # further random directions
PASSAGE = 64  # words of a benchmark passage at most; a longer item is several
WINDOW, STRIDE = 32, 8  # words of a document's window, and from one window to the next
COMMON = 3.0  # taken off every inverse document frequency: what one passage in 20 has says next to nothing
LITTLE = 0.05  # what is left of such a word's
COSINE = 0.35  # of a window with a passage in the latent space; 14 of its 32 words in a window give about 0.65
_AT_ONCE = 512  # windows projected at once
COPIED = 0.8  # of a passage's words in order: a copy
RETOLD = 0.5  # the same of its telling words for a paraphrase, if ANSWERED of the answer is there, too
ANSWER, ANSWERED = 8, 0.75
SHORT = 8  # words; a passage with fewer must be there as it is
LONG = 50  # words of an item one after the other: a copy, however much more the item has
RUN = 6  # words of a longer passage one after the other: a candidate
PASSAGES = 2000  # searched for in one pass over the documents; more take more passes

_LEAKS = "array<struct<item_id:bigint,common:int,words:int,cosine:double>>"


def common_subsequence(places: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of `words` with a passage of `size` words; places has a bit for each place of a word."""
    full = (1 << size) - 1
    state = full
    for word in words:
        hit = places.get(word)
        if hit:
            both = state & hit
            state = ((state + both) | (state - both)) & full
    return size - state.bit_count()


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the run of `size` words from each place on."""
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = mixed(h + words[k : k + len(h)])
    return h


def passages_of(items: list[tuple[int | None, str | None]]) -> list[tuple[int | None, np.ndarray]]:
    """(item, words' hashes) of every passage: a long item is cut evenly."""
    out = []
    for item_id, text in items:
        hashes = word_hashes(*flat(pa.array([text], pa.string())), bare=True)[0]
        parts = -(-len(hashes) // PASSAGE)
        out += [(item_id, part) for part in (np.array_split(hashes, parts) if parts else [])]
    return out


def overlapping(items: list[tuple[int | None, str | None]]) -> list[tuple[int | None, np.ndarray, np.ndarray, int]]:
    """(item, words' hashes, those of the whole item, place in it) of the passages searched for: those of a long item begin every quarter of a passage."""
    out = []
    for item in items:
        parts = [words for _, words in passages_of([item])]
        if not parts:
            continue
        whole, size = np.concatenate(parts), len(parts[0])
        starts = [*range(0, len(whole) - size, max(1, size // 4)), len(whole) - size]
        out += [(item[0], whole[at : at + size], whole, at) for at in starts]
    return out


def _passage_count(words: Column) -> Column:
    """How many passages overlapping() makes of an item of so many words."""
    size = F.ceil(words / F.greatest(F.ceil(words / PASSAGE), F.lit(1)))
    return F.when(words == 0, 0).otherwise(1 + F.ceil((words - size) / F.greatest(F.floor(size / 4), F.lit(1)))).cast("bigint")


class Passages:
    """Passages of one latent space: words, weights, and what the space makes of them."""

    def __init__(self, passages: list[tuple[int | None, np.ndarray, np.ndarray, int]]) -> None:
        self.item, self.words, self.whole, self.at = ([p[k] for p in passages] for k in range(4))
        whole = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        self.terms = np.unique(whole)
        self._near = np.zeros(1 << 20, bool)
        self._near[self.terms >> np.uint64(44)] = True
        self.masks = [self._places(w) for w in self.words]
        self.short: dict[int, dict[int, list[int]]] = {}  # by length and hash of the whole passage
        for k, words in enumerate(self.words):
            if len(words) < SHORT:
                self.short.setdefault(len(words), {}).setdefault(int(_runs(words, len(words))[0]), []).append(k)
        self._index_runs()
        self.answers = [w[-min(ANSWER, max(1, len(w) // 4)) :] for w in self.words]
        self.answer_masks = [self._places(w) for w in self.answers]

    def _index_runs(self) -> None:
        """Every run of RUN words of the passages that are not short: sorted hashes, and beside them the passages and places."""
        long = [k for k, w in enumerate(self.words) if len(w) >= SHORT]
        hashes = [_runs(self.words[k], RUN) for k in long]
        run = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        passage = np.repeat(np.array(long, np.int64), [len(h) for h in hashes])
        place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)])
        order = np.argsort(run, kind="stable")
        self.runs, self.run_passage, self.run_place = run[order], passage[order], place[order]
        self.near_runs = np.zeros(1 << 20, bool)
        self.near_runs[run >> np.uint64(44)] = True

    def cosine(self, words: np.ndarray, k: int) -> float:
        """Of a window's words with a passage."""
        term = self.term_of(words)
        known = term[term >= 0]
        full = (self.idf[known] ** 2).sum() + (len(term) - len(known)) * self.other**2
        return float(self.pull[known].sum(axis=0) @ self.seek[k] / np.sqrt(max(full, 1e-9)))

    @staticmethod
    def _places(words: np.ndarray) -> dict[int, int]:
        places: dict[int, int] = {}
        for k, word in enumerate(words.tolist()):
            places[word] = places.get(word, 0) | 1 << k
        return places

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the terms, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self._near[hashes >> np.uint64(44)])
        found = np.minimum(np.searchsorted(self.terms, hashes[maybe]), max(0, len(self.terms) - 1))
        hit = self.terms[found] == hashes[maybe] if len(self.terms) else np.zeros(0, bool)
        out[maybe[hit]] = found[hit]
        return out

    def weigh(self, frequency: np.ndarray, passages: int) -> None:
        """Inverse document frequencies; words that no benchmark passage has weigh half the mean term, lest they hide passages of common words."""
        self.idf = np.maximum(np.log((passages + 1) / (frequency + 1)) - COMMON, LITTLE)
        self.other = float(np.sqrt((self.idf**2).mean())) / 2 if len(self.idf) else 1.0
        telling = {w for w, idf in zip(self.terms.tolist(), self.idf.tolist(), strict=True) if idf > LITTLE}
        self.telling_masks = [{w: m for w, m in masks.items() if w in telling} for masks in self.masks]
        self.telling_sizes = [sum(m.bit_count() for m in masks.values()) for masks in self.telling_masks]

    def rows(self) -> np.ndarray:
        out = np.zeros((len(self.words), len(self.terms)))
        for i, words in enumerate(self.words):
            np.add.at(out[i], np.searchsorted(self.terms, words), 1.0)
        return out * self.idf

    def place(self, directions: np.ndarray) -> None:
        """directions: terms x rank. What each term adds to a projected window, and the passages' own projections."""
        self.pull = (self.idf[:, None] * directions).astype(np.float32)
        own = np.stack([self.pull[np.searchsorted(self.terms, w)].sum(axis=0) for w in self.words])
        length = np.array([np.sqrt((self.idf[np.searchsorted(self.terms, w)] ** 2).sum()) for w in self.words])
        # Scaled so that a window with exactly the passage's words has cosine 1, however much of the passage the space holds.
        self.seek = (own * (length / np.maximum((own**2).sum(axis=1), 1e-9))[:, None]).astype(np.float32)


def _frequencies(docs: DataFrame, spaces: list[Passages]) -> None:
    """Weigh each space's terms by how many passages of all documents have them."""
    shared = docs.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = shared.value
        counts, passages = [np.zeros(len(own.terms), np.int64) for own in spaces], 0
        for batch in batches:
            data, at = flat(batch.column(0))
            for low, high in pieces(at):
                hashes, rows = word_hashes(data[at[low] : at[high]], at[low : high + 1] - at[low], bare=True)
                sizes = -(-np.diff(rows) // WINDOW)
                first = np.concatenate([[0], np.cumsum(sizes)])
                passage = (np.arange(len(hashes)) - np.repeat(rows[:-1], np.diff(rows))) // WINDOW + np.repeat(first[:-1], np.diff(rows))
                passages += int(first[-1])
                for own, tally in zip(spaces, counts, strict=True):
                    term = own.term_of(hashes)
                    hit = term >= 0
                    key = np.sort(passage[hit] * len(own.terms) + term[hit])
                    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
                    tally += np.bincount(key % max(1, len(own.terms)), minlength=len(own.terms))
        for k, tally in enumerate(counts):
            has = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), k)), pa.array(has), pa.array(tally[has])], names=["space", "term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), pa.array([passages])], names=["space", "term", "n"])

    rows = docs.select("text").mapInArrow(run, "space bigint, term bigint, n bigint").groupBy("space", "term").agg(F.sum("n").alias("n")).collect()  # one row a term of the benchmark's block
    total = {(r["space"], r["term"]): r["n"] for r in rows}
    for k, own in enumerate(spaces):
        own.weigh(np.array([total.get((k, t), 0) for t in range(len(own.terms))], np.int64), total.get((-1, -1), 0))


def _directions(spark, found: Passages) -> np.ndarray:  # noqa: ANN001
    """The first singular directions (terms x rank) of the passages' TF-IDF matrix, by a randomised SVD over tasks of passages.

    Every task multiplies its rows A by the same random matrix; the sums of (A R)'(A R) give an orthonormal
    basis Q of A R, and the sums of (A R)' A give Q' A, whose singular vectors are the directions.
    """
    rank = min(RANK, -(-len(found.words) // 2))
    size, terms = min(rank + SPARE, len(found.words)), len(found.terms)
    shared = spark.sparkContext.broadcast(found)
    parts = spark.range(0, len(found.words), 1, max(1, -(-len(found.words) // 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        mine = np.concatenate([[], *[b.column(0).to_numpy() for b in batches]]).astype(np.int64)
        if not len(mine):
            return
        a = np.zeros((len(mine), terms))
        for i, k in enumerate(mine):
            np.add.at(a[i], np.searchsorted(own.terms, own.words[k]), 1.0)
        a *= own.idf
        y = a @ np.random.default_rng(7).standard_normal((terms, size))
        for row, value in enumerate((y.T @ y, *np.array_split(y.T @ a, max(1, terms // 64), axis=1))):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([value.ravel().tolist()], pa.list_(pa.float64()))], names=["block", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[block] = total.get(block, 0.0) + value.values.to_numpy()
        for block, value in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([value], pa.list_(pa.float64()))], names=["block", "value"])

    schema = "block int, value array<double>"
    sums = parts.mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).toArrow()  # size x (size + terms) numbers
    blocks = {k.as_py(): v.values.to_numpy() for k, v in zip(*sums.columns, strict=True)}
    gram = blocks.pop(0).reshape(size, size)
    cuts = [blocks[k].reshape(size, -1) for k in sorted(blocks)]
    values, vectors = np.linalg.eigh(gram)
    keep = values > values.max() * 1e-10
    q = (vectors[:, keep] / np.sqrt(values[keep])).T @ np.concatenate(cuts, axis=1)  # Q' A
    _, _, directions = np.linalg.svd(q, full_matrices=False)
    return directions[:rank].T


def _windows(hashes: np.ndarray, rows: np.ndarray, own: Passages) -> Iterator[tuple[int, int, int, float]]:
    """(row, first word of the window, passage, cosine) of the candidates.

    The cosine of a window's TF-IDF vector with any passage is at most the root of the share that the space's
    words have in the window's squared weights, so windows where that stays below the limit are not projected.
    """
    term = own.term_of(hashes)
    weight = np.where(term >= 0, own.idf[term] ** 2, own.other**2)
    every, known = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weight, np.where(term >= 0, weight, 0.0)))
    n = np.diff(rows)
    windows = np.where(n > 0, 1 + -(-np.maximum(n - WINDOW, 0) // STRIDE), 0)
    row = np.repeat(np.arange(len(n)), windows)
    start = rows[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    end = np.minimum(start + WINDOW, rows[1:][row])
    full = every[end] - every[start]
    rich = np.flatnonzero(known[end] - known[start] >= COSINE**2 * full)
    pull = np.concatenate([own.pull, np.zeros((1, own.pull.shape[1]), np.float32)])  # the last for other words
    for low in range(0, len(rich), _AT_ONCE):
        some = rich[low : low + _AT_ONCE]
        at = start[some][:, None] + np.arange(WINDOW)
        terms = np.where(at < end[some][:, None], term[np.minimum(at, len(term) - 1)], -1)
        cosine = pull[terms].sum(axis=1) @ own.seek.T / np.sqrt(np.maximum(full[some], 1e-9))[:, None]
        for i, k in zip(*np.nonzero(cosine >= COSINE), strict=True):
            yield int(row[some[i]]), int(start[some[i]]), int(k), float(cosine[i, k])


def _short(hashes: np.ndarray, rows: np.ndarray, own: Passages) -> Iterator[tuple[int, int, int, float]]:
    """The same for short passages, which weigh too little in a window: those whose words are there one after the other."""
    for size, passages in own.short.items():
        runs = _runs(hashes, size)
        table = np.sort(np.array(list(passages), np.uint64))
        near = np.zeros(1 << 20, bool)
        near[table >> np.uint64(44)] = True
        for start in np.flatnonzero(near[runs >> np.uint64(44)]).tolist():
            for k in passages.get(int(runs[start]), ()):
                row = int(np.searchsorted(rows, start, "right")) - 1
                if start + size <= rows[row + 1]:
                    yield row, start, k, 1.0


def _same_runs(hashes: np.ndarray, rows: np.ndarray, runs: np.ndarray, own: Passages) -> Iterator[tuple[int, int, int, None, int]]:
    """The same for places that have a run of words with a passage in common, one for each unbroken stretch; the cosine is left open.

    The place is where the passage would begin, which may be before the document does; last comes that of the run.
    """
    maybe = np.flatnonzero(own.near_runs[runs >> np.uint64(44)])
    row = np.searchsorted(rows, maybe, "right") - 1
    inside = maybe + RUN <= rows[row + 1]
    maybe, row = maybe[inside], row[inside]
    low, high = np.searchsorted(own.runs, runs[maybe]), np.searchsorted(own.runs, runs[maybe], "right")
    n = high - low
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, row, k = np.repeat(maybe, n), np.repeat(row, n), own.run_passage[at]
    begin = place - own.run_place[at]
    order = np.lexsort((place, begin, k, row))
    place, row, k, begin = place[order], row[order], k[order], begin[order]
    first = np.ones(len(place), bool)
    first[1:] = (np.diff(row) != 0) | (np.diff(k) != 0) | (np.diff(begin) != 0) | (np.diff(place) != 1)
    for i in np.flatnonzero(first).tolist():
        yield int(row[i]), int(begin[i]), int(k[i]), None, int(place[i])


def _run_around(hashes: np.ndarray, low: int, high: int, place: int, item: np.ndarray, at: int) -> int:
    """Words of the unbroken run around `place` that a document's words, low to high, share with the item's around `at`."""
    ahead, back = min(high - place, len(item) - at), min(place - low, at)
    after = np.flatnonzero(hashes[place : place + ahead] != item[at : at + ahead])
    before = np.flatnonzero((hashes[place - back : place] != item[at - back : at])[::-1])
    return int(after[0] if len(after) else ahead) + int(before[0] if len(before) else back)


def _telling(own: Passages, k: int, words: list[int]) -> int:
    """How many of a passage's telling words are there in order."""
    size = len(own.words[k])
    return common_subsequence(own.telling_masks[k], size, words)


def _checked(hashes: np.ndarray, low: int, high: int, own: Passages, k: int) -> int:
    """How many of a passage's words lie between two places of a document in order; 0 if that is no leak."""
    words, size = hashes[low:high], len(own.words[k])
    if size < SHORT:
        runs = np.lib.stride_tricks.sliding_window_view(words, size) if len(words) >= size else np.zeros((0, size))
        return size if (runs == own.words[k]).all(axis=1).any() else 0
    words = words.tolist()
    common = common_subsequence(own.masks[k], size, words)
    if common >= COPIED * size:
        return common
    telling = own.telling_sizes[k]
    if telling and _telling(own, k, words) >= max(2, RETOLD * telling):
        answer = len(own.answers[k])
        if common_subsequence(own.answer_masks[k], answer, words) >= ANSWERED * answer:
            return common
    return 0


def _search(docs: DataFrame, spaces: list[Passages]) -> DataFrame:
    """docs with `leaks` for one block of the benchmark."""
    place = docs.columns.index("text")
    schema = docs.withColumn("leaks", F.lit(None).cast(_LEAKS)).schema
    shared = docs.sparkSession.sparkContext.broadcast(spaces)  # PASSAGES bounds it, or one item's
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.int32()), ("words", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(place))
            leaks: list[dict[tuple, dict]] = [{} for _ in range(batch.num_rows)]
            for low, high in pieces(at):
                hashes, rows = word_hashes(data[at[low] : at[high]], at[low : high + 1] - at[low], bare=True)
                runs = _runs(hashes, RUN)
                for own, row, start, k, cosine, *run in ((own, *c) for own in shared.value for way in (_short(hashes, rows, own), _windows(hashes, rows, own), _same_runs(hashes, rows, runs, own)) for c in way):
                    size = len(own.words[k])
                    held = leaks[low + row].get((own.item[k],))
                    if held and (cosine is None or held["cosine"] >= cosine) and held["common"] >= COPIED * size:
                        continue
                    common = _checked(hashes, max(rows[row], start - size), min(rows[row + 1], start + WINDOW + size), own, k)
                    if run and not common and _run_around(hashes, rows[row], rows[row + 1], *run, own.whole[k], own.at[k] + run[0] - start) >= LONG:
                        common = common_subsequence(own.masks[k], size, hashes[max(rows[row], start) : min(rows[row + 1], start + size)].tolist())
                    if common and cosine is None:
                        cosine = own.cosine(hashes[max(rows[row], start) : min(rows[row + 1], start + WINDOW)], k)
                    if common and (held is None or (common, cosine) > (held["common"], held["cosine"])):
                        leaks[low + row][own.item[k],] = {"item_id": own.item[k], "common": common, "words": size, "cosine": cosine}
            found_ = [sorted(x.values(), key=lambda y: (y["item_id"] is None, y["item_id"])) for x in leaks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found_, kind)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs, with `leaks`: the benchmark items (item_id, text) whose passages a text holds.

    Each leak has the item, the words in common with its best passage, that passage's words, and the
    cosine. Whole texts are searched, whole items are searched for. Items are passages of up to PASSAGE
    words, which overlap in longer items; one passage found, or LONG words of an item one after the other, is a leak. Letter case and ASCII punctuation behind words do not count. Null
    and empty texts leak nothing, null and empty items are found nowhere. Repeated rows are judged alike, repeated
    item ids are one item; a column `leaks` is replaced, and columns named `_leaks_` and a number are not supported. Benchmarks of more than PASSAGES passages take a
    pass over the documents for each block of whole items with as many, so what tasks hold is bounded, but by the
    longest item. Nothing is shuffled but counts of benchmark words.
    """
    spark = docs.sparkSession
    out = docs.drop("leaks")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(_passage_count(word_count(F.col("text"))))).first()[0] or 0) // (PASSAGES * 4 // 5)))
    all_leaks = F.array().cast(_LEAKS)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        passages = overlapping([(r["item_id"], r["text"]) for r in rows])
        if not passages:
            continue
        spaces = [Passages(passages[low : low + SPACE]) for low in range(0, len(passages), SPACE)]
        _frequencies(docs, spaces)
        for own in spaces:
            own.place(_directions(spark, own))
        out = _search(out, spaces).withColumnRenamed("leaks", f"_leaks_{block}")
        all_leaks = F.concat(all_leaks, F.col(f"_leaks_{block}"))
    return out.withColumn("leaks", all_leaks).drop(*[f"_leaks_{b}" for b in range(blocks)])
