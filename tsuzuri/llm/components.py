"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; edges are first contracted to spanning forests inside each
partition.  Steps are written to the shared folder, so that lineage stays short.  Nothing is collected
but one count and one checksum a round.  Forests of ``ALONE`` edges at most take one task instead of the rounds, as each
round costs the driver and the executors some twenty stages whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, settle, trim

#: Edges that one task takes (16 bytes each, and about five times as much for their order).
ALONE = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests, one for each batch."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        out = [(x, root(x)) for x in parent]
        out = [(x, r) for x, r in out if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["u", "v"])


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that are not the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, least = smallest(*(np.concatenate(x) for x in zip(*parts)))
        del parts
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(least[i : i + (1 << 16)])], names=["node", "component"])
    trim()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (u, v: long); self-loops are ignored."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = settle(map_arrow(edges, _forest, "u long, v long").distinct())
    if now.count() <= ALONE:
        return settle(map_arrow(now.coalesce(1), _alone, "node long, component long"))
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        now = settle(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen.n, seen.s):
            break
        mark = (seen.n, seen.s)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
