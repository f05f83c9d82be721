"""Language-model scores by context-tree weighting over binary-decomposed bytes, and a unigram base.

Every byte is eight binary decisions, the nodes of a binary tree over byte values. For each node the
contexts, the bytes before, are a tree of their own, whose every node may be where the context ends or
go on to longer ones: context-tree weighting mixes the Krichevsky-Trofimov estimates of all depths by how well
each has coded the training bytes. Counts are gathered from all training text; contexts seen
often enough (LEAST) get a node of their own, what is left below a node is one more leaf there, so the model grows
with the corpus. It is a table of rows (context, node of the byte tree), made depth by depth, upwards
and downwards. The mixture is then fixed, so a text's score is a sum of looked-up logarithms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import flat, mixed, pieces, word_hashes
from titleworks.session import settle

DEPTH = 5  # bytes of context
LEAST = 2  # times that a context is seen which gets a node of its own
SPLIT = 3  # bytes of context: what lies below is worked on in one task, what lies above depth by depth
CODES = 1 << 21  # bytes with contexts whose logarithms every task holds; the others' are joined
_CODE_SLOTS = 22
WORDS = 1 << 18  # words whose counts every task holds; the others' are joined
SLOTS = 20  # bits of the place of a held word
_HELD = 2_000_000  # distinct counts a task holds before it passes them on
_BINS = 64
_NODES = "g bigint, zero double, one double, total double, stop double, seen double"
_MIXED = "g bigint, mixed double, left double"
_ROWS = 1024  # contexts worked on at once when a model is made


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Tally:
    """Counts by key, added up in a task."""

    def __init__(self, kind: int) -> None:
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > _HELD:
            self._merge()

    def _merge(self) -> None:
        self.parts = [_sums(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0])

    def rows(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            if self.size > least:
                keys, counts = self.parts[0]
                for low in range(0, len(keys), 100_000):
                    part = keys[low : low + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.kind, np.int8)), pa.array(part), pa.array(counts[low : low + 100_000].astype(np.int64))], names=["kind", "key", "n"])
                self.parts, self.size = [], 0


def _laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each behind DEPTH zero bytes and with a zero byte as its end.

    Returns the bytes, the places of the bytes to code (ends included), and the rows' offsets among them.
    """
    n = np.diff(at) + 1
    to = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(to[-1]) + np.repeat(np.arange(1, len(at)) * DEPTH, n)
    out = np.zeros(to[-1] + DEPTH * (len(at) - 1), np.uint8)
    ends = to[1:] - 1
    inside = np.ones(to[-1], bool)
    inside[ends] = False
    out[place[inside]] = data
    return out, place, to


def _codes(laid: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each byte to code: the byte before in the highest of 48 bits, those before it, and the byte itself in the lowest."""
    key = laid[place].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= laid[place - d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    return key


def gather(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts of docs (training, text): counts of words (0), of bytes with contexts (1) and of
    texts (2) where training holds, and of bytes with contexts elsewhere (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts, others, texts = _Tally(0), _Tally(1), _Tally(3), 0
        for batch in batches:
            training = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            texts += int(training.sum())
            data, at = flat(batch.column(1))
            for low, high in pieces(at, 1 << 20):
                own, rows = data[at[low] : at[high]], at[low : high + 1] - at[low]
                chosen = training[low:high]
                hashes, to = word_hashes(own, rows)
                words.add(hashes[np.repeat(chosen, np.diff(to))])
                laid, place, to = _laid_out(own, rows)
                key, chosen = _codes(laid, place), np.repeat(chosen, np.diff(to))
                contexts.add(key[chosen])
                others.add(key[~chosen])
                for tally in (words, contexts, others):
                    yield from tally.rows(_HELD)
        for tally in (words, contexts, others):
            yield from tally.rows()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])

    rows = docs.select("training", "text").mapInArrow(run, "kind tinyint, key bigint, n bigint")
    return settle(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _often(counts: DataFrame, by: list[str], most: int) -> dict[tuple, int]:
    """For each group the smallest count that at most `most` rows reach (1 if all rows are no more), from counts of counts in fine classes."""
    level = F.floor(F.log2("n") * _BINS).cast("int")
    bins = counts.groupBy(*by, level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("low")).collect()  # a class for each 64th of a doubling
    found: dict[tuple, int] = {}
    for group in {tuple(b[c] for c in by) for b in bins}:
        rows, low = 0, None
        for b in sorted((b for b in bins if tuple(b[c] for c in by) == group), key=lambda b: -b["level"]):
            rows += b["rows"]
            if rows > most and low is not None:
                break
            low = b["low"]
        found[group] = low if rows > most else 1
    return found


def _log_gamma(x: np.ndarray) -> np.ndarray:
    product, y = np.ones_like(x), x
    for _ in range(8):
        product *= y
        y = y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(product)


def _estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of 256 byte counts: the KT log probability of each node's bits, and the chance that its next bit is 1."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for low in (128, 64, 32, 16, 8, 4, 2, 1):
        tree[:, low : 2 * low] = tree[:, 2 * low : 4 * low : 2] + tree[:, 2 * low + 1 : 4 * low : 2]
    zero, one = tree[:, 2:512:2], tree[:, 3:512:2]  # of nodes 1..255
    log = _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - math.log(math.pi) - _log_gamma(zero + one + 1)
    return log, (one + 0.5) / (zero + one + 1)


def _bytes_of(bits: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability, from the nodes' chances of a 1."""
    logs = np.zeros((len(bits), 512))
    for low in (1, 2, 4, 8, 16, 32, 64, 128):
        p = bits[:, low - 1 : 2 * low - 1]
        logs[:, 2 * low : 4 * low : 2] = logs[:, low : 2 * low] + np.log10(1 - p)
        logs[:, 2 * low + 1 : 4 * low : 2] = logs[:, low : 2 * low] + np.log10(p)
    return logs[:, 256:].astype(np.float32)


def _kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - math.log(math.pi) - _log_gamma(zero + one + 1)


def _chance(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (one + 0.5) / (zero + one + 1)


class _Nodes:
    """Rows (context, node of the byte tree) of one depth, g = context << 8 | node in ascending order: counts of 0 and 1,
    the weighted log probability of the bits below, the share that ends here, and how often the context is seen."""

    def __init__(self, g: np.ndarray, zero: np.ndarray, one: np.ndarray, total: np.ndarray, stop: np.ndarray, seen: np.ndarray | None = None) -> None:
        self.g, self.zero, self.one, self.total, self.stop = g, zero, one, total, stop
        if seen is None:
            first = (g & 255) == 1  # every context has the first bit's node
            seen = (zero + one)[first][np.searchsorted(g[first] >> 8, g >> 8)]
        self.seen = seen

    @classmethod
    def of_codes(cls, keys: np.ndarray, n: np.ndarray) -> tuple[_Nodes, np.ndarray, np.ndarray]:
        """The nodes of depth DEPTH; for each code its eight nodes' places, and its bits."""
        byte = keys & 255
        level = np.arange(8)
        node = (1 << level) | (byte[:, None] >> (8 - level))
        bits = byte[:, None] >> (7 - level) & 1
        g, at = np.unique(((keys >> 8) << 8)[:, None] | node, return_inverse=True)
        at = at.reshape(bits.shape)
        weight = np.broadcast_to(n[:, None], bits.shape).astype(np.float64)
        zero, one = (np.bincount(at.ravel(), (weight * x).ravel(), len(g)) for x in (1 - bits, bits))
        return cls(g, zero, one, _kt(zero, one), np.ones(len(g))), at, bits

    def up(self, least: int) -> _Nodes:
        """The nodes one byte of context above; what down() needs of them is kept."""
        names, self.at = np.unique((self.g >> 16 << 8) | (self.g & 255), return_inverse=True)
        self.kept = self.seen >= least
        add = lambda x: np.bincount(self.at, x, len(names))
        zero, one = add(self.zero), add(self.one)
        rest = add(np.where(self.kept, 0, self.zero)), add(np.where(self.kept, 0, self.one))
        self.rest = _chance(*rest)
        own = _kt(zero, one)
        total = np.logaddexp(own, add(np.where(self.kept, self.total, 0)) + _kt(*rest)) - math.log(2)
        return _Nodes(names, zero, one, total, np.exp(own - math.log(2) - total))

    def down(self, mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of a 1 mixed so far, and the weight left for longer contexts, from those of the nodes of up()."""
        mixed, left = mixed[self.at], left[self.at]
        here = np.where(self.kept, self.stop * _chance(self.zero, self.one), self.rest[self.at])
        return mixed + left * here, np.where(self.kept, left * (1 - self.stop), 0.0)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.g, self.zero, self.one, self.total, self.stop, self.seen)], names=["g", "zero", "one", "total", "stop", "seen"])


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All columns of a task's rows, null as 0, in the order of the first."""
    held = list(batches)
    if not held:
        return []
    table = pa.Table.from_batches(held)
    columns = [c.combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in table.columns]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _of_parents(rows: DataFrame, parents: DataFrame, above: Column) -> DataFrame:
    """rows and parents (_MIXED) in one table, those of one context above in one task; `parent` says which is which."""
    both = rows.withColumns({"parent": F.lit(0), "to": above}).unionByName(parents.withColumns({"parent": F.lit(1), "to": F.shiftright("g", 8)}), allowMissingColumns=True)
    return both.repartition("to").drop("to")


def logarithms(codes: DataFrame, least: int = LEAST) -> DataFrame:
    """codes (key, n, ...) with `log`: log10 of the byte's probability after its context, trained on the counts n.

    Contexts seen `least` times or more have nodes. Every step upwards or downwards puts the contexts with the same shorter one
    together, 256 at most, or 65,536 below SPLIT bytes; the 256 of one byte meet on the driver.
    """
    spark = codes.sparkSession
    below = DEPTH - SPLIT
    prefix = F.shiftright("key", 8 * (below + 1))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := _columns(batches):
            nodes = _Nodes.of_codes(*columns)[0]
            for _ in range(below):
                nodes = nodes.up(least)
            yield nodes.batch()

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := _columns(batches):
            yield _Nodes(*columns).up(least).batch()

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := _columns(batches):
            *columns, parent, mixed, left = columns
            own = ~parent.astype(bool)
            nodes = _Nodes(*[c[own] for c in columns])
            nodes.up(least)
            mixed, left = nodes.down(mixed[~own], left[~own])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes.g, mixed, left)], names=["g", "mixed", "left"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := _columns(batches):
            keys, n, seen, parent, g, mixed, left = columns
            own = ~parent.astype(bool)
            order = np.argsort(g[~own])
            mixed, left = mixed[~own][order], left[~own][order]
            nodes, at, bits = _Nodes.of_codes(keys[own], n[own])
            steps = [nodes]
            for _ in range(below):
                steps.append(steps[-1].up(least))
            for step in steps[-2::-1]:
                mixed, left = step.down(mixed, left)
            one = np.clip(mixed, 1e-12, 1 - 1e-12)[at]
            logs = np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[own], seen[own], logs)], names=["key", "n", "log"])

    codes = codes.select("key", "n", "seen")
    depths = {SPLIT: settle(codes.select("key", "n", prefix.alias("to")).repartition("to").drop("to").mapInArrow(lower, _NODES), "nodes")}
    for d in range(SPLIT - 1, 0, -1):
        depths[d] = settle(depths[d + 1].withColumn("to", F.shiftright("g", 16)).repartition("to").drop("to").mapInArrow(climb, _NODES), "nodes")
    top = _columns(depths[1].toArrow().to_batches())  # 256 contexts of 255 nodes at most
    if not top:
        return codes.select("key", F.col("seen").alias("n"), F.lit(0.0).alias("log"))
    first = _Nodes(*top)
    root = first.up(least)
    mixed, left = first.down(root.stop * _chance(root.zero, root.one), 1 - root.stop)
    known = settle(spark.createDataFrame(pa.table({"g": first.g, "mixed": mixed, "left": left}), _MIXED), "mixed")
    for d in range(2, SPLIT + 1):
        known = _of_parents(depths[d], known, F.shiftright("g", 16)).select("g", "zero", "one", "total", "stop", "seen", "parent", "mixed", "left").mapInArrow(descend, _MIXED)
    both = _of_parents(codes, known, prefix).select("key", "n", "seen", "parent", "g", "mixed", "left")
    return settle(both.mapInArrow(finish, "key bigint, n bigint, log double"), "logs")


class Model:
    """The same model in memory, for a given set of contexts. `child[node, byte]`: the node one byte further back, or 0; `log[node, byte]`: log10 of a byte's probability
    where the context's longest node is `node`. Node 0 is the empty context."""

    def __init__(self, depth: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> None:
        names = np.unique(np.stack([depth, context], 1), axis=0) if len(depth) else np.zeros((0, 2), np.int64)
        place = {(int(d), int(c)): i for i, (d, c) in enumerate(names)} or {(0, 0): 0}
        size = len(place)
        counts = np.zeros((size, 256))
        np.add.at(counts, (np.array([place[int(d), int(c)] for d, c in zip(depth, context, strict=True)], np.int64), byte), n)
        parent = np.array([place[d - 1, c & ((1 << 8 * (d - 1)) - 1)] if d else -1 for d, c in place])
        self.child = np.zeros((size, 256), np.int32)
        for i, (d, c) in enumerate(place):
            if d:
                self.child[parent[i], c >> 8 * (d - 1)] = i
        rest = counts.copy()
        for low in range(1, size, _ROWS):
            np.subtract.at(rest, parent[low : low + _ROWS], counts[low : low + _ROWS])
        np.maximum(rest, 0, out=rest)
        edges = np.searchsorted([d for d, _ in place], np.arange(DEPTH + 2))  # nodes lie depth by depth
        # upwards: how well each node's own estimate and its longer contexts code the training bits
        stop = np.ones((size, 255), np.float32)
        below = None
        for d in range(DEPTH, -1, -1):
            first, last = edges[d], edges[d + 1]
            above = np.zeros((first - edges[d - 1], 255)) if d else None
            for low in range(first, last, _ROWS):
                at = slice(low, min(low + _ROWS, last))
                own = total = _estimates(counts[at])[0]
                if d < DEPTH:
                    longer = below[at.start - first : at.stop - first] + _estimates(rest[at])[0]
                    total = np.logaddexp(own, longer) - math.log(2)
                    stop[at] = np.exp(own - math.log(2) - total)
                if d:
                    np.add.at(above, parent[at] - edges[d - 1], total)
            below = above
        # downwards: the mixture along each path
        self.log = np.zeros((size, 256), np.float32)
        mixed = left = None
        for d in range(DEPTH + 1):
            first, last = edges[d], edges[d + 1]
            mixed_here, left_here = np.zeros((last - first, 255), np.float32), np.zeros((last - first, 255), np.float32)
            for low in range(first, last, _ROWS):
                at = slice(low, min(low + _ROWS, last))
                here = slice(at.start - first, at.stop - first)
                before = mixed[parent[at] - edges[d - 1]] if d else 0
                weight = left[parent[at] - edges[d - 1]] if d else np.ones((at.stop - at.start, 255), np.float32)
                mixed_here[here] = before + weight * stop[at] * _estimates(counts[at])[1]
                left_here[here] = weight * (1 - stop[at])
                final = mixed_here[here].astype(np.float64)
                if d < DEPTH:
                    final += left_here[here] * _estimates(rest[at])[1]
                self.log[at] = _bytes_of(np.clip(final, 1e-12, 1 - 1e-12))
            mixed, left = mixed_here, left_here

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text, its end included."""
        laid, place, rows = _laid_out(data, at)
        node = np.zeros(len(place), np.int32)
        child = self.child.ravel()
        going = None
        for d in range(1, DEPTH + 1):
            further = child[(node << 8) | laid[place - d]]
            going = further > 0 if going is None else going & (further > 0)
            node = np.where(going, further, node)
        logs = self.log.ravel()[(node.astype(np.int64) << 8) | laid[place]].astype(np.float64)
        return np.add.reduceat(logs, rows[:-1]) if len(rows) > 1 else np.zeros(0)


def _shared(rows: DataFrame) -> Broadcast:
    """Both columns of a few rows as arrays, for all tasks."""
    return rows.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in rows.toArrow().columns))


class HeldWords:
    """Counts of the most frequent words, at a place that their hash says. Where two share a place one is left out."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((keys, -counts))[::-1]  # the most frequent is written last
        keys, counts = keys[order].view(np.uint64), counts[order]
        at = (keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.keys, self.logs = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS)
        self.keys[at], self.logs[at] = keys, np.log10(counts + 1.0)
        self.full = self.logs > 0

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (words >> np.uint64(64 - SLOTS)).astype(np.int64)
        hit = (self.keys[at] == words) & self.full[at]
        return hit, np.where(hit, self.logs[at], 0.0)


class HeldCodes:
    """Logarithms of the codes seen most, at a place that their hash says. Where two share a place the later one stays."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        keys = keys.view(np.uint64)
        at = self._at(keys)
        self.keys, self.logs = np.full(1 << _CODE_SLOTS, 1 << 63, np.uint64), np.zeros(1 << _CODE_SLOTS)
        self.keys[at], self.logs[at] = keys, logs

    @staticmethod
    def _at(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - _CODE_SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._at(keys)
        hit = self.keys[at] == keys
        return hit, np.where(hit, self.logs[at], 0.0)


def score(docs: DataFrame, training: Column, least: int = LEAST, words: int = WORDS, codes: int = CODES) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, n_bytes, base_score, score) of every row of docs.

    docs has doc_id and text; `training` says which rows the counts come from. score is log10 of the
    probability of the text's bytes and its end under the context-tree mixture, base_score that of its
    words (A-Z as a-z) and its end under word frequencies with one added. All text is counted, all text is
    scored. Null texts count as empty, which have their end as only token. Repeated rows count again and
    are scored alike. Without training rows every bit has probability one half and every word is unknown; an
    empty table gives no rows. Counts of the `words` most frequent words and logarithms of the `codes`
    most frequent bytes with contexts are held by every task, the others' are joined, so both scores are exact. Contexts
    seen `least` times have a node.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), "text")
    counts = gather(docs)
    trained = F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0))
    logs_of = logarithms(counts.where("kind IN (1, 3)").groupBy("key").agg(trained.alias("n"), F.sum("n").alias("seen")), least)
    most = logs_of.where(F.col("n") >= (_often(logs_of, [], codes).get((), 1) or 1)).orderBy("n").select("key", "log")
    held_codes = _shared(most)  # about `codes` rows
    known = counts.where("kind = 0").select("key", "n")
    total, distinct = known.agg(F.sum("n"), F.count("*")).first()
    texts = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    n_train, distinct = (total or 0) + texts, distinct + (texts > 0)
    low = _often(known, [], words).get((), 1) or 1
    held = _shared(known.where(F.col("n") >= low))  # about `words` rows
    each = math.log10(n_train + distinct + 1)
    end = math.log10(texts + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId() << 33, 0
        top_words, top_codes = HeldWords(*held.value), HeldCodes(*held_codes.value)  # the driver holds no more than their rows
        for batch in batches:
            data, at = flat(batch.column(2))
            for a, b in pieces(at, 1 << 20):
                own, rows = data[at[a] : at[b]], at[a : b + 1] - at[a]
                hashes, to = word_hashes(own, rows)
                hit, logs = top_words.find(hashes)
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                hits = np.concatenate([[0], np.cumsum(hit)])
                missed = hashes[~hit].view(np.int64)
                gaps = to - hits[to]
                laid, place, ends = _laid_out(own, rows)
                keys = _codes(laid, place)
                coded, code_logs = top_codes.find(keys)
                code_sums = np.concatenate([[0.0], np.cumsum(code_logs)])
                code_gaps = np.concatenate([[0], np.cumsum(~coded)])[ends]
                lists = [pa.ListArray.from_arrays(pa.array(x.astype(np.int32)), pa.array(y)) for x, y in ((gaps, missed), (code_gaps, keys[~coded].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part + row + np.arange(b - a)), batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(to) + 1), pa.array(np.diff(hits[to])), pa.array(np.diff(rows)),
                        pa.array(np.diff(sums[to])), pa.array(np.diff(code_sums[ends])), *lists,
                    ],
                    names=["row", "doc_id", "training", "n_tokens", "found", "n_bytes", "logs", "score", "missed", "missed_codes"],
                )
                row += b - a

    schema = "row bigint, doc_id bigint, training boolean, n_tokens bigint, found bigint, n_bytes bigint, logs double, score double, missed array<bigint>, missed_codes array<bigint>"
    scored = settle(docs.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("missed").alias("key")).join(known, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    rare_codes = scored.select("row", F.explode("missed_codes").alias("key")).join(logs_of.select("key", "log"), "key").groupBy("row").agg(F.sum("log").alias("more_score"))
    joined = scored.drop("missed", "missed_codes").join(rare, "row", "left").join(rare_codes, "row", "left")
    sums = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(each)
    seen = F.col("found") + F.coalesce("more", F.lit(0)) + F.lit(1 if texts else 0)
    return joined.select("doc_id", "training", "n_tokens", seen.alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"), "n_bytes", sums.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
