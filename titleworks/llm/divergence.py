"""How far the sources of a language differ in their words, from bitmaps of terms per count.

A language's kept terms are dealt to blocks by hash and numbered inside them. For each group (language, source)
and each count that occurs there, a block stores the bitset of the terms with that count (only words that are not
zero). The joint cells of two groups, how many terms have count a here and count b there, are popcounts of ANDs;
cells where a count is zero come by complement. A pair's value is the sum of cells times the cell's difference, so
no term is ever looked up for a pair. All sums are of integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.llm.text import flat, pieces
from titleworks.session import settle

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TERM_RANKS = 50
BLOCK = 1 << 14  # terms of a block, about
TILE = 64  # groups of a tile, about; tiles meet in pairs
HELD_TERMS = 1 << 18  # entries that a task holds before it gives its counts away (about 10 MB; twice that while they are added)
BROADCAST_ROWS = 50_000  # rows about languages or groups that are broadcast (a few MB); more are joined by a shuffle
_BATCH = 50_000
_CELLS = 1 << 21  # words that are ANDed at once

_IN_TERM = np.zeros(256, bool)  # letters, and on UTF-8 the bytes of all characters above 7F
_IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_GROUP = ["lang", "source"]


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts given as bytes and offsets, and the text of each."""
    inside = _IN_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    bounds = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # where one text ends and another begins
    begins[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLDED[data[inside]])])
    return held, np.searchsorted(at, starts, "right") - 1


def _counted(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of some texts."""
    terms, row = terms_of(data, at)
    coded = terms.dictionary_encode()
    size = max(1, len(coded.dictionary))
    key, n = np.unique(row * np.int64(size) + coded.indices.to_numpy(), return_counts=True)
    own = group[key // size] * np.int64(size) + key % size
    order = np.argsort(own, kind="stable")
    key, first = np.unique(own[order], return_index=True)
    sums = np.add.reduceat(n[order], first) if len(first) else n
    return pa.table({"group": key // size, "term": coded.dictionary.take(pa.array(key % size)), "n": sums, "docs": np.diff(np.append(first, len(order)))})


def _tasks_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up inside each task as far as its memory goes."""

    def added(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table([found[c] for c in ("group", "term", "n_sum", "docs_sum")], names=["group", "term", "n", "docs"])

    def rows(found: pa.Table, groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
        out = pa.table([langs.take(found["group"].combine_chunks()), sources.take(found["group"].combine_chunks()), found["term"].cast(pa.string()), found["n"], found["docs"]], names=["lang", "source", "term", "n", "docs"])
        yield from out.to_batches(max_chunksize=_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        groups: dict[tuple[str, str], int] = {}
        for batch in batches:
            data, at = flat(batch.column(2))
            group = np.array([groups.setdefault(k, len(groups)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            for low, high in pieces(at):
                held.append(_counted(data[at[low] : at[high]], at[low : high + 1] - at[low], group[low:high]))
                if sum(len(t) for t in held) > 2 * HELD_TERMS:
                    held = [added(held)]
                    if len(held[0]) > HELD_TERMS:
                        yield from rows(held[0], groups)
                        held = []
        if held:
            yield from rows(added(held), groups)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count: 1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTHING).cast("decimal(1,0)"))
    below = wide(total) + F.lit(SMOOTHING).cast("decimal(1,0)") * wide(terms)
    return F.when(terms > 0, F.lit(1) + F.call_function("div", above, below))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The count of every kept term in each group that has it, (lang, term, source, n, all_n, block, place), and the
    groups, (lang, source, total, terms, zero, all_total, all_zero, blocks), groups without terms as well.

    total and all_total are the counts' sums in the group and the language, terms is how many the language keeps,
    zero the share of a count of zero. place numbers the terms of a block from 0.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = settle(_tasks_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least).drop("docs")
    kept = settle(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    langs = settle(langs.withColumn("blocks", F.ceil(F.col("terms") / BLOCK).cast("int")), "languages")
    numbered = kept.join(_small(langs.select("lang", "blocks")), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    numbered = settle(numbered.withColumn("place", place), "numbered")
    found = settle(counts.drop("docs").join(numbered, ["lang", "term"]), "kept-counts")
    totals = found.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    groups = docs.select(*_GROUP).distinct().join(totals, _GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "all_total"]).na.fill(1, ["blocks"])
    zero = lambda total: share(F.lit(0), F.col(total), F.col("terms"))
    return found, settle(groups.withColumns({"zero": zero("total"), "all_zero": zero("all_total")}), "groups")


_STORE = "lang string, source string, block int, p array<bigint>, level array<int>, word array<int>, bits array<bigint>"


def bitmaps(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Bitsets of each group and block: (lang, source, block, p, level, word, bits).

    p holds the share of each level (a count that occurs); bitset words that are not zero follow as (level, word number, 64 bits).
    """
    rows = found.join(_small(groups.select(*_GROUP, "total", "terms")), _GROUP)
    rows = rows.select(*_GROUP, "block", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.floor(F.col("place") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int")).alias("bit"))
    words = rows.groupBy(*_GROUP, "block", "p", "word").agg(F.bit_or("bit").alias("bits"))

    def pack(table: pa.Table) -> pa.Table:
        p, level = np.unique(table["p"].to_numpy(), return_inverse=True)
        head = [table[c][0].as_py() for c in (*_GROUP, "block")]
        return pa.table([*([x] for x in head), [p], [level.astype(np.int32)], [table["word"].to_numpy()], [table["bits"].to_numpy()]], names=_STORE_NAMES).cast(_STORE_SCHEMA)

    return settle(words.groupBy(*_GROUP, "block").applyInArrow(pack, _STORE), "bitmaps")


_STORE_NAMES = [c.split()[0] for c in _STORE.split(", ")]
_STORE_SCHEMA = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("p", pa.list_(pa.int64())), ("level", pa.list_(pa.int32())), ("word", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))]
)


class Levels:
    """One group's bitsets in a block: sparse, and as a matrix of one row per level."""

    def __init__(self, p: np.ndarray, level: np.ndarray, word: np.ndarray, bits: np.ndarray, zero: int, width: int) -> None:
        order = np.argsort(level, kind="stable")
        self.p, self.level, self.word, self.bits, self.zero = p, level[order], word[order], bits[order].view(np.uint64), zero
        self.starts = np.searchsorted(self.level, np.arange(len(p)))
        self.matrix = np.zeros((len(p), width), np.uint64)
        self.matrix[self.level, self.word] = self.bits
        self.sizes = np.bitwise_count(self.matrix).sum(axis=1, dtype=np.int64)


def joint(a: Levels, b: Levels) -> np.ndarray:
    """How many terms have level i in a and level j in b: AND and popcount of every pair of bitsets."""
    out = np.zeros((len(b.p), len(a.p)), np.int64)
    if out.size:
        step = max(1, _CELLS // max(len(a.word), 1))
        for low in range(0, len(b.p), step):
            both = np.bitwise_count(b.matrix[low : low + step, a.word] & a.bits)
            out[low : low + step] = np.add.reduceat(both, a.starts, axis=1, dtype=np.int64)
    return out.T


def difference(a: Levels, b: Levels, terms: int) -> int:
    """The sum of |p - q| over a block's terms."""
    cells = joint(a, b)
    only_a, only_b = a.sizes - cells.sum(axis=1), b.sizes - cells.sum(axis=0)
    neither = terms - int(cells.sum() + only_a.sum() + only_b.sum())
    total = (cells * np.abs(a.p[:, None] - b.p[None, :])).sum() + (only_a * np.abs(a.p - b.zero)).sum() + (only_b * np.abs(b.p - a.zero)).sum()
    return int(total) + neither * abs(a.zero - b.zero)


def pair_values(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways."""
    sizes = found.groupBy("lang", "block").agg((F.max("place") + 1).alias("size"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    cells = groups.select(*_GROUP, "zero", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = cells.join(sizes, ["lang", "block"], "left").join(bitmaps(found, groups), [*_GROUP, "block"], "left").join(tiles, "lang")
    cells = cells.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select(*_GROUP, "block", "zero", "size", "p", "level", "word", "bits", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py() or 0
        array = lambda name, k, kind: np.array(table[name][k].as_py() or [], kind)
        rows = [Levels(array("p", k, np.int64), array("level", k, np.int64), array("word", k, np.int64), array("bits", k, np.int64), table["zero"][k].as_py() or 0, -(-size // 64)) for k in range(len(table))]
        names, tile = table["source"].to_pylist(), table["tile"].to_pylist()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        out = []
        for x in range(len(rows)):
            for y in range(len(rows)):
                if (x < y) if i == j else (tile[x] == i and tile[y] == j):
                    value = difference(rows[x], rows[y], size)
                    out += [(names[x], names[y], value), (names[y], names[x], value)]
        lang = table["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([r[0] for r in out], pa.string()), "item": pa.array([r[1] for r in out], pa.string()), "value": pa.array([r[2] for r in out], pa.int64())})

    parts = cells.groupBy("lang", "block", "i", "j").applyInArrow(compare, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every kept term that a group has and that is more frequent there than in the language."""
    rows = found.join(_small(groups.select(*_GROUP, "total", "terms", "all_total")), _GROUP)
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    return rows.select(*_GROUP, F.col("term").alias("item"), value.alias("value")).where("value > 0")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source, ...): part `pair` compares each source with every
    other of its language, part `term` lists the terms that set it apart from the language, up to `ranks`.

    A language keeps the terms that at least `least` of its documents have. Null text, lang and source are empty strings,
    so they make a group of their own. Ties rank by item in UTF-8 order. A source without terms, or in a language that
    keeps none, has pairs (of value 0 in the latter) and no terms; the only source of a language has no pairs. Rows that
    repeat are counted as often as they occur; texts are whole; other columns are ignored; an empty table gives no rows.
    """
    found, groups = kept_counts(docs, least)
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item"))
    pairs = pair_values(found, groups).select(*_GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = term_values(found, groups).withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.union(terms.select(*_GROUP, F.lit("term").alias("part"), "item", "value", "rank"))
