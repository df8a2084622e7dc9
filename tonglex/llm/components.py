"""Connected components of an edge list, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, map_arrow, stage_table

CHUNK = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a-b, without the roots themselves; vectorised hooking and jumping."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ix[: len(a)].copy(), ix[len(a) :].copy()
    parent = np.arange(len(nodes))
    while len(u):
        lo, hi = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(parent, hi, lo)
        while True:
            nxt = parent[parent]
            if (nxt == parent).all():
                break
            parent = nxt
        u, v = parent[u], parent[v]
        keep = u != v
        u, v = u[keep], v[keep]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a partition's edges becomes stars around its smallest nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out():
        x, r = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(r)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _jumped(labels: DataFrame, parent: DataFrame, mark: bool = False) -> DataFrame:
    """labels with every root replaced by that root's own root; mark: and whether it had another one."""
    up = parent.select(F.col("node").alias("root"), F.col("root").alias("top")).where("root <> top")
    moved = [F.col("top").isNotNull().alias("moved")] if mark else []
    return labels.select("node", "root").join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), *moved)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root) for every node of an edge; root is the smallest node reachable.

    Rounds of hooking each node to its smallest neighbour, pointer doubling until roots are reached,
    and contraction of the edges, each written to the shared folder. No node's neighbours are gathered:
    minima are aggregated before they are shuffled. An empty edge list gives an empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = stage_table(map_arrow(e, _local, "a long, b long", rows=None).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("moved"))
        parent = stage_table(parent, "parent")
        while not parent.where("moved").isEmpty():
            parent, old = stage_table(_jumped(parent, parent, mark=True), "parent"), parent
            drop_stage(old)
        if labels is None:
            labels = stage_table(parent.select("node", "root"), "labels")
        else:
            labels, old = stage_table(_jumped(labels, parent), "labels"), labels
            drop_stage(old)
        ends = [parent.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        next_e = e.join(ends[0], "a").join(ends[1], "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b")
        e, old = stage_table(map_arrow(next_e, _local, "a long, b long", rows=None).distinct(), "edges"), e
        drop_stage(old)
        drop_stage(parent)
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
