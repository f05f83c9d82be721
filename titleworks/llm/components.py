"""Connected components of links, by alternating large and small stars (MapReduce-style)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleworks.session import settle

ONE_TASK = 1_000_000  # links (16 MB) that one task joins at once; more go through the rounds


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a bounded number of links: labels sink along links, and each label to its own label."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the label is the smallest node reachable.

    Each round hangs every node's larger neighbours below its smallest one, then its smaller ones.
    Only per-node minima are aggregated, so a hub's neighbours are never in one task together; a
    round's links are written to the shared folder, so lineage stays short. Rounds grow with the
    logarithm of the longest chain. Up to ONE_TASK links are joined in one task instead, with the same
    result. Links of a node to itself are ignored; no links give no rows.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= ONE_TASK:
        return settle(edges.coalesce(1).mapInArrow(_joined, "node bigint, label bigint"), "components")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least)
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
