"""Scoring every title against every candidate without ever holding or shipping the full table.

A pick's score is built from percentile ranks among *all* of a title's candidates, so every pair
counts and none may be skipped. Candidates are packed once, a block of them to a row, and written to
the shared folder; each task meets its groups of queries with all these rows, one after the other, so
candidates are read again but never shuffled to the queries. A block's pairs are scored as one small
matrix product, and only a short summary of them stays:
  - how many candidates have each tag cosine (a candidate's tags are one of few sets),
  - of each tag cosine the best pool by text cosine, as equal tags leave the order to the text,
  - the HELD highest text cosines, from which the ranks of those are counted.
Titles that may pick candidates below the held cosines (rare tags, no lists of other titles) ask once
more, in groups so small that all their text cosines can be held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleworks.session import settle

TEXT_WEIGHT, TAG_WEIGHT = 0.7, 0.3
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
# Query blocks that a task scores one after the other, so that candidates are read less often; fewer where that leaves few tasks.
BLOCKS_AT_ONCE, LEAST_TASKS = 32, 64
# Equal pairs must compare equal whatever block they are in, so cosines are whole numbers of this.
UNIT = 1e-9
# Text cosines held of a query at first, and bytes of them where all are held.
HELD, ALL_HELD = 8192, 128_000_000
_DENSE_BYTES = 64_000_000
# Share of all pairs from which an id's pairs are cheaper in a dense product.
_DENSE_FROM = 0.004
# Packed rows of candidates that Spark keeps beside its managed memory, from which they can be spilled.
_ROWS_IN_MEMORY = 4

PROFILE = ["mal_id", "term_ids", "weights", "tags", "series_rule", "series_codes", "slot"]
PICK = "anime_id bigint, similar_id bigint, slot string, text_cosine double, tag_cosine double, score float"
_NO_ID = np.iinfo(np.int64).max


def _one_row(**columns: pa.Array) -> bytes:
    """Columns of any lengths, as bytes."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _combined(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _rows_of(lists: pa.Array) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _pack(rows: pa.Table) -> bytes:
    """Titles as columns of numbers: entries by term, distinct sets of tags, series codes by name."""
    term_ids, weights, codes = (_combined(rows[name]) for name in ("term_ids", "weights", "series_codes"))
    term, row, w = term_ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), _rows_of(term_ids), weights.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((row, term))
    term, row, w = term[order], row[order], w[order]
    terms, ends = np.unique(term, return_index=True)

    has_text = np.bincount(row, minlength=len(rows)) > 0
    known: dict[tuple, int] = {}
    of_row = [known.setdefault((tuple(sorted(set(t or ()))), bool(h)), len(known)) for t, h in zip(rows["tags"].to_pylist(), has_text, strict=True)]

    code = codes.flatten().dictionary_encode()
    at = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by_code = np.argsort(at, kind="stable")
    return _one_row(
        ids=_combined(rows["mal_id"]).cast(pa.int64()), slots=_combined(rows["slot"]).cast(pa.string()), rules=_combined(rows["series_rule"]).cast(pa.string()),
        terms=pa.array(terms), ends=pa.array(np.r_[ends, len(term)].astype(np.int64)), rows=pa.array(row), weights=pa.array(w.astype("f8")),
        sets=pa.array([k[0] for k in known], pa.list_(pa.string())), texts=pa.array([k[1] for k in known], pa.bool_()), set_of=pa.array(of_row, pa.int32()),
        codes=code.dictionary.cast(pa.string()), code_ends=pa.array(np.searchsorted(at[by_code], np.arange(len(code.dictionary) + 1)).astype(np.int64)),
        code_rows=pa.array(_rows_of(codes)[by_code]),
    )


class Block:
    """Some titles, as `_pack` wrote them."""

    def __init__(self, packed: pa.Buffer) -> None:
        row = pa.ipc.open_stream(packed).read_next_batch()
        of = {name: column.values for name, column in zip(row.schema.names, row.columns, strict=True)}
        numbers = lambda name: of[name].to_numpy(zero_copy_only=False)
        self.known = of["ids"].is_valid().to_numpy(zero_copy_only=False)
        self.ids = of["ids"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.slots = of["slots"].to_numpy(zero_copy_only=False)
        self.rules = of["rules"].to_pylist()
        self.terms, self.ends, self.rows, self.weights = (numbers(name) for name in ("terms", "ends", "rows", "weights"))
        self.sets = [(frozenset(s), t) for s, t in zip(of["sets"].to_pylist(), of["texts"].to_pylist(), strict=True)]
        self.set_of = numbers("set_of")
        self.codes = {c: i for i, c in enumerate(of["codes"].to_pylist())}
        self.code_ends, self.code_rows = numbers("code_ends"), numbers("code_rows")
        self.n = len(self.ids)

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of some terms (by number), and which of these terms each one has."""
        n = self.ends[terms + 1] - self.ends[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return np.arange(len(which)) + (self.ends[terms] - np.cumsum(n) + n)[which], which


def _products(q: Block, c: Block) -> np.ndarray:
    """Cosines of all titles of a block with all of another, in units.

    Terms that many titles of both blocks have go through a dense product; the few pairs of each of the
    others are added one title at a time.
    """
    total = np.zeros((q.n, c.n))
    _, q_at, c_at = np.intersect1d(q.terms, c.terms, assume_unique=True, return_indices=True)
    common = np.diff(q.ends)[q_at].astype("f8") * np.diff(c.ends)[c_at] > _DENSE_FROM * total.size
    step = max(1, _DENSE_BYTES // (8 * (q.n + c.n)))
    for at in range(0, int(common.sum()), step):
        q_part, c_part = q_at[common][at : at + step], c_at[common][at : at + step]
        left, right = np.zeros((len(q_part), q.n)), np.zeros((len(c_part), c.n))
        for matrix, block, part in ((left, q, q_part), (right, c, c_part)):
            entry, which = block.entries(part)
            matrix[which, block.rows[entry]] = block.weights[entry]
        total += left.T @ right

    entry, which = q.entries(q_at[~common])
    starts, sizes = c.ends[c_at[~common]], np.diff(c.ends)[c_at[~common]]
    order = np.argsort(q.rows[entry], kind="stable")
    weights, which = q.weights[entry[order]], which[order]
    own = np.searchsorted(q.rows[entry[order]], np.arange(q.n + 1))
    for i in range(q.n):
        some, row = which[own[i] : own[i + 1]], total[i]
        if len(some):
            n = sizes[some]
            at = np.arange(n.sum()) + np.repeat(starts[some] - np.cumsum(n) + n, n)
            row += np.bincount(c.rows[at], c.weights[at] * np.repeat(weights[own[i] : own[i + 1]], n), c.n)
        row *= 1 / UNIT
        np.rint(row, out=row)
    return total


def _shares(n: np.ndarray) -> np.ndarray:
    """Percentile rank of each value from how often it is there, lowest first; ties share the average, a flat row is 0."""
    if np.count_nonzero(n) < 2:
        return np.zeros(len(n))
    return (np.cumsum(n) - n + (n + 1) / 2 - 1) / (n.sum() - 1)


def percentiles(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Percentile rank of each allowed score in its row."""
    result = np.zeros_like(scores, dtype="f8")
    for i, keep in enumerate(allowed):
        _, at, n = np.unique(scores[i, keep], return_inverse=True, return_counts=True)
        result[i, keep] = _shares(n)[at]
    return result


class _TagSide:
    """How titles with one set of tags see the sets of candidates met so far."""

    def __init__(self, tags: frozenset) -> None:
        self.tags, self.cosine, self.class_of, self.classes = tags, np.empty(0), np.empty(0, np.int64), {}

    def meet(self, sets: list[tuple[frozenset, bool]]) -> None:
        """Learn the sets that are new: their tag cosine, and their class of equal cosine and of text or none."""
        new = sets[len(self.cosine) :]
        weight = lambda tags: 1 / math.sqrt(len(tags))
        cosine = [round(len(self.tags & t) * weight(self.tags) * weight(t), 9) if self.tags & t else 0.0 for t, _ in new]
        self.class_of = np.r_[self.class_of, [self.classes.setdefault((x, text), len(self.classes)) for x, (_, text) in zip(cosine, new, strict=True)]].astype(np.int64)
        self.cosine = np.r_[self.cosine, cosine]


class _Asking:
    """What is kept for one title: the pool of each class, and the highest text cosines."""

    def __init__(self) -> None:
        self.n, self.low, self.high, self.cut = 0, np.inf, -np.inf, -1.0
        self.values, self.held = [], 0
        self.hidden = []  # sets of candidates that it must not pick
        self.least, self.last = np.empty(0), np.empty(0, np.int64)  # a class keeps no lower text cosine, and at it no later id
        self.kept, self.pending = [], 0

    def hold(self, row: np.ndarray, most: int | None) -> None:
        new = row[row > self.cut]
        self.values.append(new)
        self.held += len(new)
        if most is not None and self.held > 2 * most:
            every = np.concatenate(self.values)
            self.cut = np.partition(every, len(every) - most)[len(every) - most]
            self.values = [every[every > self.cut]]
            self.held = len(self.values[0])

    def prune(self, pool: int) -> None:
        text, ids, klass, of_set, slot = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((ids, -text, klass))
        new = np.r_[True, np.diff(klass[order]) != 0][: len(order)]
        place = np.arange(len(order))
        place = place - np.maximum.accumulate(np.where(new, place, 0))
        ends = order[place == pool - 1]
        self.least[klass[ends]], self.last[klass[ends]] = text[ends], ids[ends]
        keep = order[place < pool]
        self.kept, self.pending = [(text[keep], ids[keep], klass[keep], of_set[keep], slot[keep])], 0


class Search:
    """Some titles that meet all candidates, a block at a time."""

    def __init__(self, packed: pa.Buffer, pool: int, skip: bool, held: int | None, lists: int | None) -> None:
        self.q, self.pool, self.skip, self.most, self.lists = Block(packed), pool, skip, held, lists
        self.sets: dict[tuple[frozenset, bool], int] = {}
        self.counts = np.empty(0, np.int64)
        self.sides = [_TagSide(tags) for tags, _ in self.q.sets]
        self.asking = [_Asking() for _ in range(self.q.n)]

    def meet(self, c: Block) -> None:
        q = self.q
        set_of = np.array([self.sets.setdefault(s, len(self.sets)) for s in c.sets], np.int64)[c.set_of]
        self.counts = np.bincount(set_of, minlength=len(self.sets)) + np.r_[self.counts, np.zeros(len(self.sets) - len(self.counts), np.int64)]
        sets = list(self.sets)
        by_id = np.argsort(c.ids, kind="stable")
        left, right = (np.searchsorted(c.ids[by_id], q.ids, side) for side in ("left", "right"))
        cosines, last = _products(q, c), None
        for number in np.argsort(q.set_of, kind="stable"):
            mine = q.set_of[number]
            if mine != last:
                self.sides[mine].meet(sets)
                last, class_of, members = mine, self.sides[mine].class_of[set_of], {}
            hidden = [by_id[left[number] : right[number]]] if q.known[number] else []
            code = c.codes.get(q.rules[number]) if self.skip and q.rules[number] is not None else None
            if code is not None:
                hidden.append(c.code_rows[c.code_ends[code] : c.code_ends[code + 1]])
            hidden = np.unique(np.concatenate(hidden)) if hidden else np.empty(0, np.int64)
            self._one(self.asking[number], self.sides[mine], cosines[number], hidden, c, set_of, class_of, members)

    def _one(self, a: _Asking, side: _TagSide, row: np.ndarray, hidden: np.ndarray, c: Block, set_of: np.ndarray, class_of: np.ndarray, members: dict) -> None:
        allowed = row
        if len(hidden):
            row[hidden] = -1
            allowed = row[row >= 0]
            a.hidden.append(set_of[hidden])
        if not len(allowed):
            return
        a.n += len(allowed)
        a.low, a.high = min(a.low, allowed.min()), max(a.high, allowed.max())
        a.hold(row, self.most)
        if len(a.least) < len(side.classes):
            # A pick shares a tag or a word.
            new = [0.0 if cosine > 0 else 1.0 for cosine, _ in list(side.classes)[len(a.least) :]]
            a.least, a.last = np.r_[a.least, new], np.r_[a.last, np.full(len(new), _NO_ID)]
        at = np.flatnonzero(row >= a.least[class_of])
        if len(at) > 8 * self.pool:
            for k in range(len(a.least)):
                if k not in members:
                    members[k] = np.flatnonzero(class_of == k)
                some = row[members[k]]
                if len(some) > self.pool:
                    end = np.partition(some, len(some) - self.pool)[len(some) - self.pool]
                    if end > a.least[k]:
                        a.least[k], a.last[k] = end, _NO_ID
            at = at[row[at] >= a.least[class_of[at]]]
        at = at[(row[at] > a.least[class_of[at]]) | (c.ids[at] <= a.last[class_of[at]])]
        if len(at):
            a.kept.append((row[at], c.ids[at], class_of[at], set_of[at], c.slots[at]))
            a.pending += len(at)
            if a.pending > 16 * self.pool:
                a.prune(self.pool)

    def found(self) -> tuple[list[tuple], list[int]]:
        """(number, ids, slots, text, tag, score) of the titles that are done, and the numbers of those that are not."""
        done, rest = [], []
        values = [np.unique(side.cosine[: len(self.counts)], return_inverse=True) if len(side.cosine) else None for side in self.sides]
        for number, a in enumerate(self.asking):
            if not a.kept:
                continue
            a.prune(self.pool)
            text, ids, klass, of_set, slot = a.kept[0]
            side, (_, value_of) = self.sides[self.q.set_of[number]], values[self.q.set_of[number]]
            n = np.bincount(value_of, self.counts)
            if a.hidden:
                n -= np.bincount(value_of[np.concatenate(a.hidden)], minlength=len(n))
            tag = _shares(n)[value_of[of_set]]
            both = np.array([t for _, t in side.classes])[klass] & self.q.sets[self.q.set_of[number]][1]
            known = np.ones(len(text), bool)
            share = np.zeros(len(text))
            if a.low < a.high:
                held = np.sort(np.concatenate(a.values))
                below, upto = (np.searchsorted(held, text, x) for x in ("left", "right"))
                known = ~both | (text > a.cut)
                # Those at or below the cut come after all that are held.
                rank = np.where(text > a.cut, a.n - len(held) + below + (upto - below + 1) / 2, a.n - len(held))
                share = np.where(both, (rank - 1) / max(a.n - 1, 1), 0.0)
            score = (TEXT_WEIGHT * share + TAG_WEIGHT * tag).astype("f4")
            best = np.lexsort((ids, -score))
            sure = best[known[best]][: self.pool]
            if (score[~known] >= (score[sure[-1]] if len(sure) == self.pool else -np.inf) - 1e-6).any():
                rest.append(number)
                continue
            if self.lists is not None:
                _, first = np.unique(slot[sure].astype(str), return_index=True)
                sure = sure[np.sort(first)[: self.lists]]
            done.append((number, ids[sure], slot[sure], text[sure] * UNIT, side.cosine[of_set[sure]], score[sure]))
        return done, rest


def _packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of titles as rows of packs of about `size` titles, numbered within the task."""
    held, n, number = [], 0, 0

    def packs(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal held, n, number
        rows = pa.Table.from_batches(held)
        while n >= least and n:
            part = min(n, size) if n > size + size // 4 else n
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "packed": pa.array([_pack(rows.slice(0, part))], pa.binary())})
            rows, n, number = rows.slice(part), n - part, number + 1
        held = rows.to_batches()

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= 2 * size:
            yield from packs(2 * size)
    if n:
        yield from packs(1)


def _blocks(queries: int, candidates: int, query_block: int, candidate_block: int) -> tuple[int, int]:
    """How many groups of queries, each of which meets every candidate block, and how many candidate blocks."""
    n_c = max(1, math.ceil(candidates / candidate_block))
    single = max(1, math.ceil(queries / query_block))
    return max(math.ceil(single / BLOCKS_AT_ONCE), min(single, math.ceil(LEAST_TASKS / n_c))), n_c


def _met(asking: DataFrame, candidates: DataFrame, schema: str, pool: int, skip: bool, held: int | None, lists: int | None, most: int) -> DataFrame:
    """Every pack of titles with every pack of candidates, in the order of the titles: (picks) or (packs that must ask again)."""
    names = [field.split()[0] for field in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float32(), pa.binary()]

    def ended(search: Search, packed: pa.Buffer) -> pa.RecordBatch:
        done, rest = search.found()
        sizes = [len(d[1]) for d in done]
        number = np.repeat([d[0] for d in done], sizes).astype(np.int64)
        joined = [np.concatenate([d[k] for d in done]) if done else [] for k in range(1, 6)]
        ids = [pa.array(i, pa.int64(), mask=~k) for i, k in ((search.q.ids[number], search.q.known[number]), (np.asarray(joined[0], np.int64), np.asarray(joined[0], np.int64) != _NO_ID))]
        again = [_chosen(packed, rest[at : at + most]) for at in range(0, len(rest), most)]
        columns = [*ids, *(pa.array(c, t) for c, t in zip(joined[1:], types[2:6], strict=True))]
        columns = [pa.concat_arrays([c, pa.nulls(len(again), c.type)]) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(number), pa.binary()), pa.array(again, pa.binary())])], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = at = own = None
        for batch in batches:
            for number, asked, packed in zip(*batch.columns, strict=True):
                if search is None or number.as_py() != at:
                    if search is not None:
                        yield ended(search, own)
                    at, own = number.as_py(), asked.as_py()
                    search = Search(own, pool, skip, held, lists)
                search.meet(Block(packed.as_buffer()))
        if search is not None:
            yield ended(search, own)

    # One partition of candidates, so that a task meets its packs with all of them. They are as large as they need be: beyond a few rows, Spark manages their memory.
    asking.sparkSession.conf.set("spark.sql.cartesianProductExec.buffer.in.memory.threshold", str(_ROWS_IN_MEMORY))
    right = candidates.select(F.col("packed").alias("own")).coalesce(1).hint("shuffle_replicate_nl")
    return asking.select("number", "packed").crossJoin(right).select("number", "packed", "own").mapInArrow(score, schema)


def _chosen(packed: bytes, numbers: list[int]) -> bytes:
    """The pack of some titles of a pack."""
    row = pa.ipc.open_stream(packed).read_next_batch()
    of = {name: column.values for name, column in zip(row.schema.names, row.columns, strict=True)}
    place = np.full(len(of["ids"]), -1)
    place[numbers] = np.arange(len(numbers))
    ends, rows = (of[name].to_numpy(zero_copy_only=False) for name in ("ends", "rows"))
    keep = np.flatnonzero(place[rows] >= 0)
    of["ends"] = pa.array(np.searchsorted(keep, ends).astype(np.int64))
    of["rows"], of["weights"] = pa.array(place[rows[keep]].astype(np.int32)), of["weights"].take(pa.array(keep))
    for name in ("ids", "slots", "rules", "set_of"):
        of[name] = of[name].take(pa.array(numbers, pa.int64()))
    # Only those that are picked need codes.
    of |= {"codes": of["codes"].slice(0, 0), "code_ends": pa.array([0], pa.int64()), "code_rows": of["code_rows"].slice(0, 0)}
    return _one_row(**of)


def best_pairs(
    queries: DataFrame,
    candidates: DataFrame,
    pool: int,
    skip_series: bool = True,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    lists: int | None = None,
) -> DataFrame:
    """Each query's `pool` best candidates with both cosines and the blended score (a float).

    With `lists`, only the best of each slot leave the pool, so many of them at most.
    """
    asked, offered = queries.count(), candidates.count()
    query_block, candidate_block = min(query_block, QUERY_BLOCK), min(candidate_block, CANDIDATE_BLOCK)
    groups, n_c = _blocks(asked, offered, query_block, candidate_block)
    tasks = max(groups, min(math.ceil(asked / query_block), LEAST_TASKS), 1)
    packed = "number bigint, packed binary"
    rows = candidates.select(*PROFILE).repartition(n_c)
    blocks = settle(rows.mapInArrow(lambda batches: _packs(batches, candidate_block), packed), "candidates")
    asking = queries.select(*PROFILE).repartition(tasks).mapInArrow(lambda batches: _packs(batches, query_block), packed)
    most = max(1, ALL_HELD // (8 * max(offered, 1)))
    schema = PICK + ", again binary"
    first = settle(_met(asking, blocks, schema, pool, skip_series, HELD, lists, min(most, query_block)), "pairs")
    found = first.where("again is null").drop("again")
    again = first.where("again is not null").select(F.xxhash64("again").alias("number"), F.col("again").alias("packed"))
    open_packs = again.count()
    if not open_packs:
        return found
    again = again.repartition(min(open_packs, max(tasks, LEAST_TASKS)))
    return found.unionByName(_met(again, blocks, schema, pool, skip_series, None, lists, 1).drop("again"))
