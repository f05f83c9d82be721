"""Near copies by HyperMinHash: compressed bucket minima, banded, estimated, then verified.

A document's set of word shingles is cut into buckets by hash. Of each bucket's smallest hash only
the count of leading zeros and ten mantissa bits are kept: 16 bits a bucket. Four registers are a
band; sets that share a band are candidates, their Jaccard similarity is estimated from the equal
registers (less the ones equal by chance), and what may reach the limit is verified on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleworks.llm.components import components
from titleworks.llm.text import flat, mixed, pieces, shingle_hashes, word_hashes
from titleworks.session import settle

BANDS = 24  # a pair at 0.8 shares none of them with probability (1 - 0.8 ** 4) ** 24 = 3e-6
ROWS = 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
SLACK = 4.0  # standard errors that an estimate may lie below the limit before a pair is left out
BLOCK = 256  # rows of a band that meet the same number of others in one step
BROADCAST_IDS = 2_000_000  # 16 MB; more ids are joined by a shuffle

FINE = 2048  # registers of the second estimate, for sets that are still apart; an odd sketch of as many bits is kept

_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
_EDGES = {m: np.array([-(-(b << 64) // m) for b in range(m)], dtype=np.uint64) for m in (REGISTERS, FINE)}
_TRIES = np.random.default_rng(20240301).integers(0, REGISTERS, (4096, REGISTERS), dtype=np.int16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each sorted set of hashes: a matrix of 16-bit registers. Sets must not be empty.

    An empty bucket takes the register of the first bucket in a fixed random order that is not
    empty, so that registers of small sets agree as often as those of large ones.
    """
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        place = np.searchsorted(s, _EDGES[REGISTERS])
        ends = np.append(place[1:], len(s))
        has = place < ends
        full[i] = has
        least[i, has] = s[place[has]] * np.uint64(REGISTERS)  # the low 64 bits: the place inside the bucket
    part, power = np.frexp(least.astype(np.float64) + 1.0)
    out = (((65 - power) << MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    todo = np.flatnonzero(~full.all(axis=1))
    held, done = full.copy(), full[todo].copy()
    for order in _TRIES:
        if not len(todo):
            return out
        found = ~done & held[todo][:, order]
        row, column = np.nonzero(found)
        out[todo[row], column] = out[todo[row], order[column]]
        done |= found
        going = ~done.all(axis=1)
        todo, done = todo[going], done[going]
    for i, d in zip(todo, done, strict=True):  # then the next one that is not empty
        at = np.flatnonzero(held[i])
        for c in np.flatnonzero(~d):
            out[i, c] = out[i, at[np.searchsorted(at, c) % len(at)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the expected share of chance hits.

    Minima of unrelated sets have exponential distributions, and fall into the same cell (whose
    width is about 0.72 / 2 ** MANTISSA of their value) with probability
    0.72 / 2 ** MANTISSA * n_a * n_b / (n_a + n_b) ** 2.
    """
    equal = (a == b).mean(axis=1)
    chance = 0.72 / (1 << MANTISSA) * n_a * n_b / (n_a + n_b).astype(np.float64) ** 2
    return (equal - chance) / (1 - chance)


def odd_sketch(s: np.ndarray) -> bytes:
    """Two rows of FINE bits: which buckets of a set are not empty, and which bits their registers turn over, each one its own by hash."""
    place = np.searchsorted(s, _EDGES[FINE])
    has = place < np.append(place[1:], len(s))
    turned = np.bincount((mixed(s[place[has]] ^ np.uint64(FINE)) >> np.uint64(53)).astype(np.int64), minlength=FINE)
    return np.packbits(np.concatenate([has, (turned & 1).astype(bool)])).tobytes()


def fine_estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of all sets of x to all of y (sketches as 64-bit words), and their standard errors near 0.8.

    The turned bits that differ tell how many registers do, the buckets of either set what they are a share of. Errors come
    from bits turned twice, and from registers standing for more elements than one; sets of few shingles have hardly any.
    """
    half = FINE // 64
    apart, either = np.zeros((len(x), len(y)), np.int64), np.zeros((len(x), len(y)), np.int64)
    for k in range(half):
        either += np.bitwise_count(x[:, k, None] | y[None, :, k])
        apart += np.bitwise_count(x[:, half + k, None] ^ y[None, :, half + k])
    full = [np.bitwise_count(z[:, :half]).sum(axis=1, dtype=np.int64) for z in (x, y)]
    differ = -FINE / 2 * np.log(np.maximum(1 - 2 * apart / FINE, 1e-3))
    same = (full[0][:, None] + full[1][None, :] - differ) / 2
    elements = -FINE * np.log(np.maximum(1 - either / FINE, 1e-4))  # of the union, about
    turned = 0.25 * (np.expm1(0.8 * either / FINE) * FINE - 0.8 * either) / np.maximum(either, 1) ** 2  # 0.4 of the buckets' registers differ
    sampled = 0.16 / np.maximum(either, 1) * (1 - either / np.maximum(elements, either + 1e-9))
    return same / np.maximum(either, 1), np.sqrt(turned + sampled)


def forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Places of the edges (x, y) of a heaviest spanning forest of the parts; each round, every part takes its heaviest edge."""
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((y, x, weight))] = np.arange(len(x))
    at_rank = np.argsort(rank)
    live, label, taken = np.arange(len(x)), part.copy(), []
    while True:
        live = live[label[x[live]] != label[y[live]]]
        if not len(live):
            return np.concatenate(taken) if taken else live
        best = np.full(label.max() + 1, -1)
        np.maximum.at(best, label[x[live]], rank[live])
        np.maximum.at(best, label[y[live]], rank[live])
        chosen = at_rank[np.unique(best[best >= 0])]
        taken.append(chosen)
        root = np.arange(len(best))
        u, v = label[x[chosen]], label[y[chosen]]
        while (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            root = root[root]
        label = root[label]


def sets_of(column: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each row, piece by piece."""
    data, at = flat(column)
    for low, high in pieces(at):
        h, rows = word_hashes(data[at[low] : at[high]], at[low : high + 1] - at[low])
        shingles, to = shingle_hashes(h, rows, words)
        yield [np.unique(shingles[to[i] : to[i + 1]]) for i in range(high - low)]


def _set_id(s: np.ndarray) -> int:
    """An id of the whole set: any other set has another one, but for 64-bit chance."""
    place = mixed(s + np.uint64(len(s)))
    return int((mixed(np.array([place.sum() ^ np.bitwise_xor.reduce(s)], np.uint64))[0] >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, place, text_hash, n, set_id, sketch) of every document; the last two are null without words.

    place is how a text is found again: the doc_id, or where that is null the text's own hash.
    """
    schema = "doc_id bigint, place bigint, text_hash bigint, n bigint, set_id bigint, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, made = [], [], []
            for sets in sets_of(batch.column(3), words):
                n += [len(s) for s in sets]
                own = [s for s in sets if len(s)]
                made += [r.tobytes() for r in registers(own)] if own else []
                ids += [_set_id(s) for s in own]
            rest, keys = iter(made), iter(ids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array([next(keys) if c else None for c in n], pa.int64()), pa.array([next(rest) if c else None for c in n], pa.binary())],
                names=["doc_id", "place", "text_hash", "n", "set_id", "sketch"],
            )

    return _placed(docs).mapInArrow(run, schema)


def _placed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    hashed = F.xxhash64("text")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, hashed).alias("place"), hashed.alias("text_hash"), "text")


def _banded(sets: DataFrame) -> DataFrame:
    """(band, set_id): one row for each band of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
            keys = mixed(sketch ^ _BAND).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["band", "set_id"])

    return sets.select("set_id", "sketch").mapInArrow(run, "band bigint, set_id bigint")


def _passing(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    limit = percent / 100
    low = limit - SLACK * np.sqrt(limit * (1 - limit) / a.shape[1])
    size = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return size & (estimate(a, b, n_a, n_b) >= low)


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of set ids that may reach the limit."""
    one = lambda side: sets.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
            keep = _passing(x, y, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """(band, set_id, part, rows, main) of the bands whose sets are not all in one component; main is the component of the smallest set."""
    own = members.join(label.select(F.col("node").alias("set_id"), "label"), "set_id", "left")
    own = own.select("band", "set_id", F.coalesce("label", "set_id").alias("part"), (F.col("set_id") == F.col("anchor")).alias("first"))
    tally = own.groupBy("band").agg(F.count("*").alias("rows"), F.max(F.when(F.col("first"), F.col("part"))).alias("main"), F.min("part").alias("low"), F.max("part").alias("high"))
    return settle(own.drop("first").join(tally.where("low < high").select("band", "rows", "main"), "band"), "apart")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _cells(own: DataFrame, whole: bool) -> DataFrame:
    """Rows of bands in cells (band, i, j) of at most about two blocks; other: outside the component of the band's smallest set.

    whole: every such row (those rows seek) meets all rows of the band; they are few where a band is large, as that set's
    own copies are linked by now. Else each row meets its own block.
    """
    own = own.withColumn("other", F.col("part") != F.col("main"))
    block = lambda count: F.ceil(F.col(count) / BLOCK).cast("int")
    at = lambda of: F.pmod(F.xxhash64("set_id"), F.col(of)).cast("int")
    if not whole:
        return own.withColumn("i_of", block("rows")).select("band", at("i_of").alias("i"), F.lit(0).alias("j"), F.lit(True).alias("seeks"), F.lit(True).alias("other"), "set_id", "part")
    others = own.where("other").groupBy("band").agg(F.count("*").alias("others"))
    sized = own.join(others, "band").withColumns({"i_of": block("rows"), "j_of": block("others")})
    left = sized.select("band", at("i_of").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_of") - 1)).alias("j"), F.lit(False).alias("seeks"), "other", "set_id", "part")
    right = sized.where("other").select("band", F.explode(F.sequence(F.lit(0), F.col("i_of") - 1)).alias("i"), at("j_of").alias("j"), F.lit(True).alias("seeks"), "other", "set_id", "part")
    return left.union(right)


def _by_cell(cells: DataFrame, of_cell: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What of_cell makes of the rows of each cell."""
    cells = cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "seeks", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in ("band", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            low = 0
            if held and batch.num_rows and any(held[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in ("band", "i", "j")):
                yield of_cell(pa.Table.from_batches(held))
                held = []
            for cut in cuts:
                held.append(batch.slice(low, cut - low))
                yield of_cell(pa.Table.from_batches(held))
                held, low = [], cut
            if low < batch.num_rows:
                held.append(batch.slice(low))
        if held:
            yield of_cell(pa.Table.from_batches(held))

    return cells.mapInArrow(run, schema)


def _candidates(rows: pa.Table, percent: int, slack: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs in a cell that are of different components and may reach the limit, and how alike they look.

    A pair whose sets both seek is met twice and counts once; a pair that shares several bands counts in the first of
    them if bands are whole (there, sets of different components meet in every band that they share).
    """
    ids, n, part = (rows.column(k).to_numpy() for k in ("set_id", "n", "part"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, FINE // 32)
    seeks, other = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("seeks", "other"))
    asking = np.flatnonzero(seeks)
    asked = asking if seeks.all() else np.flatnonzero(~seeks)
    likely, error = fine_estimate(bits[asking], bits[asked])
    size = 100 * np.minimum(n[asking, None], n[None, asked]) >= percent * np.maximum(n[asking, None], n[None, asked])
    once = ~other[None, asked] | (ids[asking, None] < ids[None, asked])
    x, y = np.nonzero(size & once & (likely >= percent / 100 - slack * error - 1e-6) & (part[asking, None] != part[None, asked]))
    weight = likely[x, y]
    x, y = asking[x], asked[y]
    if whole and len(x):
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u8").reshape(-1, BANDS)
        first = (sketch[x] == sketch[y]).argmax(axis=1)
        here = mixed(sketch[x, first] ^ _BAND[first]).view(np.int64) == rows.column("band")[0].as_py()
        x, y, weight = x[here], y[here], weight[here]
    return x, y, weight


def _across(cells: DataFrame, full: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Links (a, b) between the components of cells: a spanning forest, for each cell, of the pairs whose full sets reach the limit.

    Bits are compared inside a task, which leaves the rows that have a likely pair; those meet again with their full
    sets, and pairs are verified where they meet, forest by forest: what a link has joined is not compared again. So no step makes
    more rows than its cells have, however many pairs may pass.
    """
    alike, slack = sets.select("set_id", "sketch") if whole else None, SLACK

    def filled(rows: DataFrame, *columns: str) -> DataFrame:
        rows = rows.join(full.select("set_id", "n", "bits", *columns), "set_id")
        return rows if alike is None else rows.join(alike, "set_id")

    names = ["band", "i", "j", "seeks", "other", "set_id", "part"]

    def likely(rows: pa.Table) -> pa.RecordBatch:
        x, y, _ = _candidates(rows, percent, slack, whole)
        some = pa.array(np.union1d(x, y), pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(k).combine_chunks().take(some) for k in names], names=names)

    def links(rows: pa.Table) -> pa.RecordBatch:
        x, y, weight = _candidates(rows, percent, slack, whole)
        ids, hashes = rows.column("set_id").to_numpy(), rows.column("hashes")
        part = np.unique(rows.column("part").to_numpy(), return_inverse=True)[1]
        own = lambda i: np.frombuffer(hashes[i].as_buffer(), np.uint64)
        a, b = [], []
        while len(x):
            tried = forest(x, y, weight, part)
            for k in tried:
                if _reaches(own(int(x[k])), own(int(y[k])), percent):
                    a.append(min(ids[x[k]], ids[y[k]]))
                    b.append(max(ids[x[k]], ids[y[k]]))
                    part[part == part[y[k]]] = part[x[k]]
            left = part[x] != part[y]
            left[tried] = False
            x, y, weight = x[left], y[left], weight[left]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    kinds = "band bigint, i int, j int, seeks boolean, other boolean, set_id bigint, part bigint"
    marked = settle(_by_cell(filled(cells), likely, kinds), "likely")
    return _by_cell(filled(marked, "hashes"), links, "a bigint, b bigint").distinct()


def _full_sets(members: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(set_id, n, bits, hashes) of all sets that share a band: their texts are read again, once."""
    wanted = settle(members.select("set_id").distinct().join(sets.select("set_id", "place"), "set_id"), "wanted")
    ids = wanted.select("place").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = _placed(docs).join(ids, "place", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in sets_of(batch.column(0), words):
                own = [s for s in found if len(s)]
                columns = [([_set_id(s) for s in own], pa.int64()), ([len(s) for s in own], pa.int64()), ([odd_sketch(s) for s in own], pa.binary()), ([s.tobytes() for s in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["set_id", "n", "bits", "hashes"])

    made = texts.mapInArrow(run, "set_id bigint, n bigint, bits binary, hashes binary")
    same = made.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id")  # equal ids may name several texts
    return settle(same.agg(*(F.first(c).alias(c) for c in ("n", "bits", "hashes"))), "full-sets")


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the limit."""
    one = lambda side: full.select(F.col("set_id").alias(side), F.col("hashes").alias(f"hashes_{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "hashes_a", "hashes_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(_reaches(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a bigint, b bigint")


def _linked(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only the labels at their ends are joined anew."""
    at = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}"))
    ends = links.join(at("a"), "a").join(at("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    moved = components(ends).select(F.col("node").alias("label"), F.col("label").alias("moved"))
    return settle(label.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")), "labels")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group, set_id, place, text_hash) of every row of docs (doc_id, text, ...).

    Documents are linked if their sets of `words`-word shingles have a Jaccard similarity of at least
    `percent` %. component_id is the smallest doc_id reachable over links, kept marks the rows that
    carry it. Equal sets are one set from the start, so exact copies cost one row each. Sets that
    share a band are compared with the band's smallest set first; what that links is one component, and then
    only sets of different components that share a band are compared, all of them: large bands first inside blocks, then every pair that
    is still apart. Pairs are verified where they meet, and only a forest of links leaves a cell, so no pair that
    shares a band is left out, and no step makes a row for each pair of a large group.

    group is the component's smallest set, whether or not a row of it has an id; place and text_hash, the hash of the
    text, find a row's text again.

    Null and empty texts, and texts of white space, have no shingles, no set and no group and are linked with nothing.
    Texts with fewer words than `words` have one shingle. Rows with a null doc_id take part; their
    component_id is null only if no linked row has an id. Repeated rows are copies of each other, and
    all rows with the kept id are marked as kept. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = settle(sketches(docs, words), "sketches")
    sets = settle(rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("place", "sketch")).alias("s"), F.max("n").alias("n")).select("set_id", "doc_id", "n", "s.place", "s.sketch"), "sets")
    bands = settle(_banded(sets), "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("rows"), F.min("set_id").alias("anchor")).where("rows > 1").select("band", "anchor")
    members = settle(bands.join(shared, "band"), "shared-bands")
    full = _full_sets(members, docs, sets, words)
    stars = settle(_estimated(members.where("set_id <> anchor").select(*_pair("anchor", "set_id")).distinct(), sets, percent), "candidates")
    first = components(_verified(stars, full, percent))
    label = settle(full.select(F.col("set_id").alias("node")).join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    for whole in (False, True):  # large bands first: what a block links by itself need not be found between blocks
        apart = _apart(members, label)
        apart = apart if whole else apart.where(F.col("rows") > BLOCK)
        if not apart.isEmpty():
            links = settle(_across(_cells(apart, whole), full, sets, percent, whole), "links")
            label = label if links.isEmpty() else _linked(label, links)
    named = sets.select("set_id", "doc_id").join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.select("set_id", "doc_id", F.coalesce("label", "set_id").alias("label"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(smallest, "label").select("set_id", "component_id", F.col("label").alias("group"))
    out = rows.select("doc_id", "place", "text_hash", "n", "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group", "set_id", "place", "text_hash")
