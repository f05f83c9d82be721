"""Exact copies by compressed radix (Patricia) tries over length, content hash and whole text.

A key is the normalised text's length and SHA-256, then its bytes, so a trie's upper levels are
partitions by length and content hash and equality is decided by the full bytes below. Terminal
nodes hold the owner: the copy that stays. Every task first merges its own copies in a trie, so
that of a text with very many copies one row a task is shuffled; the merged tries' terminals
meet, sorted by key, in a second trie. A trie over its memory limit gives away its largest subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleworks.llm.text import SPACES, flat
from titleworks.session import settle

HELD_BYTES = 32 << 20  # text that a task's trie holds before it gives a subtree away
BATCH_BYTES = 8 << 20
_KEY = "length bigint, sha binary, text binary, owner_rank bigint, owner bigint, copies bigint"


class Node:
    """`edge` leads to the node from above; `owner` is set where a key ends."""

    __slots__ = ("children", "copies", "edge", "owner")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.children, self.owner, self.copies = edge, {}, None, 0


def better(a: tuple, b: tuple) -> tuple:
    """The owner of two: (code points, doc_id) with the most code points, then the smallest id, null last."""
    return min(a, b, key=lambda o: (-o[0], o[1] is None, o[1] or 0))


class Trie:
    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def insert(self, key: bytes, owner: tuple, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                self.bytes += len(child.edge)
                at = len(key)
            elif key.startswith(child.edge, at):
                at += len(child.edge)
            else:  # the edge parts from the key: a new node between
                same = _common(child.edge, key, at)
                between = Node(child.edge[:same])
                node.children[key[at]] = between
                child.edge = child.edge[same:]
                between.children[child.edge[0]] = child
                child = between
                at += same
            node = child
        node.owner = owner if node.owner is None else better(node.owner, owner)
        node.copies += copies

    def take(self, node: Node, path: bytes) -> Iterator[tuple[bytes, tuple, int]]:
        """Every key below a node, with its owner and copies."""
        todo = [(node, path)]
        while todo:
            node, path = todo.pop()
            if node.owner is not None:
                yield path, node.owner, node.copies
            todo += [(c, path + c.edge) for c in node.children.values()]

    def all(self) -> Iterator[tuple[bytes, tuple, int]]:
        yield from self.take(self.root, b"")
        self.root, self.bytes = Node(b""), 0

    def spill(self) -> Iterator[tuple[bytes, tuple, int]]:
        """Give away the largest subtree below the root's first fork."""
        top, path = self.root, b""
        while len(top.children) == 1 and top.owner is None:
            top = next(iter(top.children.values()))
            path += top.edge
        if not top.children:
            yield from self.all()
            return
        sizes = {k: self.size(c) for k, c in top.children.items()}
        first = max(sizes, key=lambda k: (sizes[k], -k))
        gone = top.children.pop(first)
        self.bytes -= sizes[first]
        yield from self.take(gone, path + gone.edge)

    def size(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            total += len(node.edge)
            todo += node.children.values()
        return total


def _common(edge: bytes, key: bytes, at: int) -> int:
    n = min(len(edge), len(key) - at)
    a, b = np.frombuffer(edge, np.uint8, n), np.frombuffer(key, np.uint8, n, at)
    return int(np.argmax(a != b)) if (a != b).any() else n


def _normal(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, at = flat(batch.column(column))
    whole = memoryview(data)
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield bytes(whole[low:high]).translate(None, SPACES)


def _rows(found: Iterator[tuple[bytes, tuple, int]]) -> Iterator[pa.RecordBatch]:
    """Terminals as rows, in batches of bounded bytes."""
    held, size = [], 0
    for key, owner, copies in found:
        held.append((int.from_bytes(key[:8], "big"), key[8:40], key[40:], *owner, copies))
        size += len(key) + 64
        if size > BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["length", "sha", "text", "owner_rank", "owner", "copies"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def exact_copies(docs: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text, ...).

    Texts are copies if they are equal without the characters 20, 09-0D hex; null counts as empty, and
    all empty texts are copies of each other. The copy with the most code points of the original text
    stays, of those the one with the smallest doc_id; ids are preferred to null. Rows that repeat the kept
    doc_id in its group are all marked as kept: nothing tells them apart. An empty table gives no rows;
    other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("points"), "text")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for doc_id, points, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _normal(batch, 2), strict=True):
                trie.insert(len(text).to_bytes(8, "big") + hashlib.sha256(text).digest() + text, (points, doc_id), 1)
                while trie.bytes > held_bytes:
                    yield from _rows(trie.spill())
        yield from _rows(trie.all())

    def settle_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by length and hash, so a trie is complete when the next hash begins."""

        def finished() -> Iterator[tuple[bytes, tuple, int]]:
            trie, current = Trie(), None
            for batch in batches:
                columns = [batch.column(k) for k in range(batch.num_columns)]
                for length, sha, text, rank, owner, copies in zip(*columns, strict=True):
                    head = length.as_py().to_bytes(8, "big") + sha.as_py()
                    if current is not None and head != current:
                        yield from ((key[:40], *rest) for key, *rest in trie.all())
                    current = head
                    trie.insert(head + text.as_py(), (rank.as_py(), owner.as_py()), copies.as_py())
            yield from ((key[:40], *rest) for key, *rest in trie.all())

        yield from _rows(finished())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(len(t), hashlib.sha256(t).digest()) for t in _normal(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in texts], pa.int64()), pa.array([h for _, h in texts], pa.binary())], names=["doc_id", "length", "sha"])

    merged = docs.mapInArrow(merge, _KEY).repartition("length", "sha").sortWithinPartitions("length", "sha")
    owners = merged.mapInArrow(settle_owners, _KEY).select("length", "sha", "owner", "copies").where("copies > 1")
    rows = docs.mapInArrow(hashed, "doc_id bigint, length bigint, sha binary")
    joined = rows.join(settle(owners, "owners"), ["length", "sha"], "left")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("owner"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
