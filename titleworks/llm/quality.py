"""Document quality from supervised subword embeddings.

A document is the average of learned vectors of its hashed words and of their n-grams of characters, word boundaries
included, and of how far back each word occurred before (which tells texts that repeat themselves). A softmax over the average gives the class. The model is trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows, whose features, not texts, come to the driver. Since the softmax is linear in the
average, a trained model scores a text by one number for each feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import SPACES, flat, pieces, word_hashes

BITS = 15  # of a feature's place, for words and for each length of n-gram
GRAMS = (1, 2, 3, 4)  # characters, one longer than the one before
KINDS = 2 + len(GRAMS)
SIZE = (1 + len(GRAMS)) * (1 << BITS) + 64
WIDTH = 8  # of a vector
SAMPLE = 2400  # labelled rows that the model is fitted on, about
STEPS = 24_000  # of gradient descent, one document each, however many documents there are


def _recurrence(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word a feature of its distance to the same word before (by doublings), and whether that is the distance of the word before it, too."""
    keys = words + np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    distance = np.zeros(len(words), np.int64)
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
    distance[order[again]] = order[again] - order[again - 1]
    steady = np.zeros(len(words), bool)
    steady[1:] = (distance[1:] == distance[:-1]) & (distance[1:] > 0)
    return (SIZE - 64 + np.minimum(np.frexp(distance.astype(np.float64))[1], 31) * 2 + steady).astype(np.int32)


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the places of all its occurrences in the texts, in order, and the texts' offsets."""
    words, rows = word_hashes(data, at, fold=False)
    yield (words >> np.uint64(64 - BITS)).astype(np.int32), rows
    yield _recurrence(words, rows), rows
    yield from _grams(data, at)


def _characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as numbers, white space as 0, with a 0 before every text and after the last; and the place of each of these 0."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(starts, len(data)))
    code = data[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    code[np.isin(data[starts], np.frombuffer(SPACES, np.uint8))] = 0
    first = np.searchsorted(starts, at)
    return np.insert(code, first, 0), first + np.arange(len(at))


def _grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for the n-grams of characters: those inside a word, and those that take in one of its boundaries or both."""
    code, first = _characters(data, at)
    gap = code == 0
    gaps = np.append(np.flatnonzero(gap), len(code))
    ahead = gaps[np.cumsum(gap)] - np.arange(len(code))  # characters to the next boundary
    ahead[-1] = 0  # nothing begins at the last
    hashes = np.zeros(len(code), np.uint32)
    for k, size in enumerate(GRAMS):
        there = len(code) - size + 1
        if there <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(at), np.int64)
            continue
        hashes = (hashes[:there] ^ code[size - 1 :]) * np.uint32(0x9E3779B1)
        hashes ^= hashes >> np.uint32(15)
        whole = ~gap if size == 1 else ahead[:there] >= np.where(gap[:there], max(2, size - 1), size - 1)
        begins = np.flatnonzero(whole)
        places = ((hashes[begins] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32) + np.int32((k + 1) << BITS)
        yield places, np.searchsorted(begins, first)


def _bags(docs: DataFrame) -> DataFrame:
    """(doc_id, label, places, shares): each text's distinct features and their shares, each kind of feature weighing the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(2))
            for low, high in pieces(at):
                made = list(features(data[at[low] : at[high]], at[low : high + 1] - at[low]))
                places, shares = [], []
                for i in range(high - low):
                    found = [np.unique(p[to[i] : to[i + 1]], return_counts=True) for p, to in made]  # no feature is of two kinds
                    places.append(np.concatenate([own for own, _ in found]).astype(np.int32).tobytes())
                    shares.append(np.concatenate([n / max(1, n.sum()) / KINDS for _, n in found]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], pa.array(places, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "label", "places", "shares"])

    return docs.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, places binary, shares binary")


class Model:
    """Vectors of all features and the softmax's weights, for two classes."""

    def __init__(self, width: int = WIDTH, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.vectors = random.uniform(-1 / width, 1 / width, (SIZE, width)).astype(np.float32)
        self.weights = random.normal(0, 1 / width, (2, width)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rate: float = 0.3, seed: int = 12) -> Model:
        """Stochastic gradient descent, one document a step; each coordinate's steps shrink with the gradients it has seen."""
        random = np.random.default_rng(seed)
        seen_v, seen_w, seen_b = np.full_like(self.vectors, 1e-8), np.full_like(self.weights, 1e-8), np.full_like(self.bias, 1e-8)
        epochs = -(-steps // len(bags))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in random.permutation(len(bags)):
                places, shares = bags[i]
                average = shares @ self.vectors[places]
                out = self.weights @ average + self.bias
                p = np.exp(out - out.max())
                error = p / p.sum()
                error[labels[i]] -= 1
                back = error @ self.weights
                for value, seen, gradient in ((self.weights, seen_w, np.outer(error, average)), (self.bias, seen_b, error)):
                    seen += gradient**2
                    value -= step * gradient / np.sqrt(seen)
                gradient = shares[:, None] * back[None, :]
                seen_v[places] += gradient**2
                self.vectors[places] -= step * 0.1 * gradient / np.sqrt(seen_v[places])
        return self

    def pull(self) -> tuple[np.ndarray, float]:
        """What one occurrence of each feature adds to the log odds of class 1, before averaging, and the constant."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all bags, as bytes: one row, or none without bags."""
    found = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
    if found is None:
        return
    ids, marks, places, shares = found.columns
    order = sorted(range(found.num_rows), key=lambda i: (ids[i].as_py(), marks[i].as_py(), zlib.crc32(places[i].as_buffer())))
    bags = [(np.frombuffer(places[i].as_buffer(), np.int32), np.frombuffer(shares[i].as_buffer(), np.float32)) for i in order]
    model = Model().fit(bags, np.array([marks[i].as_py() for i in order]))
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.weights, model.bias)], names=["vectors", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` labelled documents for which `training` (over doc_id) holds, chosen by a hash of the id.

    docs has doc_id and text; labels doc_id and the label, 0 or 1, other values and nulls are left out.
    One task fits that bounded sample, so its features do not pass through the driver.
    Repeated ids are repeated examples. Without any labelled rows the model knows nothing and gives one half.
    """
    id_ = F.col("doc_id").cast("bigint")
    rows = labels.select(id_.alias("doc_id"), F.col(label).cast("int").alias("label")).where(training & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(1, n)))))
    texts = docs.select(id_.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # about `sample` rows
    found = _bags(texts).repartition(1).mapInArrow(_fitted, "vectors binary, weights binary, bias binary").first()
    model = Model()
    if found is not None:
        model.vectors = np.frombuffer(found.vectors, np.float32).reshape(model.vectors.shape)
        model.weights = np.frombuffer(found.weights, np.float32).reshape(model.weights.shape)
        model.bias = np.frombuffer(found.bias, np.float32)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with `quality_score`: the probability, 0 to 1, that a text's label is 1.

    Whole texts are scored, by nothing but their characters; null and empty texts have no features and get the
    model's constant. Every row is scored on its own. A column `quality_score` is replaced; an empty table
    gives no rows.
    """
    kept = docs.drop("quality_score")
    place = kept.columns.index("text")
    schema = kept.withColumn("quality_score", F.lit(None).cast("double")).schema
    pull = kept.sparkSession.sparkContext.broadcast(model.pull())  # SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = pull.value
        for batch in batches:
            data, at = flat(batch.column(place))
            logits = []
            for low, high in pieces(at):
                total = np.zeros(high - low)
                for places, to in features(data[at[low] : at[high]], at[low : high + 1] - at[low]):
                    has = np.flatnonzero(to[1:] > to[:-1])
                    if len(has):
                        total[has] += np.add.reduceat(weights[places], to[:-1][has], dtype=np.float64) / np.diff(to)[has] / KINDS
                logits.append(total + bias)
            odds = np.concatenate(logits) if logits else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)
