"""Approximate nearest neighbours by inner product with a forest of random-projection trees.

Vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm, so that the nearest by distance
is the largest by inner product.  A tree splits at the median of a random projection; it is fitted on
at most ``FIT_ROWS`` distinct vectors, in the order of a hash, and then indexes every row.  A query walks all
trees with one shared priority queue, ordered by the smallest margin to a split on the way, and visits
the best leaves of the whole forest; how many is the least number of a rising series at which the
fitted rows find ``TARGET`` of their neighbours among themselves.  Each leaf's vectors meet the queries that visit it in one task, where exact inner
products in double precision give the leaf's best; the best of all leaves are merged for each query.

Equal vectors are one class before they are indexed, with the smallest k + 1 of their ids, so that a
very common vector fills no leaf; the ids come back when neighbours are counted.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, neither as queries nor as candidates, and rows without an id neither.  Repeated ids are one row, that with the
smallest vector.  Ties go to the smaller id.  An empty table gives no rows.  Columns other than id and vector are not
read.  Scores are taken in double precision on the vectors as they are; only the trees use single precision.

Vectors that fill their space evenly, as the test tables' do, leave a forest little to tell: the leaves that hold
``TARGET`` of the neighbours then hold a large share of all rows (see the README).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, settle, shuffle_width, slices

TREES = 10
FIT_ROWS = 50_000
LEAF = 512
#: Recall among the fitted rows that the number of visited leaves is chosen for.
TARGET = 0.96
TUNED_ON = 60
SEED = 20
#: Found rows that a task holds before it thins them to the best of each query.
HELD = 300_000


class Tree:
    """Splits as arrays: node i goes to 2i+1 (below the cut) or 2i+2; a node without a direction is a leaf."""

    def __init__(self, data: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.ways: list[np.ndarray] = []
        self.cut: dict[int, tuple[int, float]] = {}
        todo = [(0, np.arange(len(data)))]
        while todo:
            node, at = todo.pop()
            if len(at) <= leaf or node > 1 << 40:
                continue
            a, b = data[rng.choice(at, 2, replace=False)]
            way = (a - b) + 1e-3 * rng.standard_normal(data.shape[1])
            way /= np.linalg.norm(way) or 1.0
            x = data[at] @ way
            cut = float(np.median(x))
            low = x < cut
            if not low.any() or low.all():
                continue
            self.cut[node] = (len(self.ways), cut)
            self.ways.append(way.astype(np.float32))
            todo += [(2 * node + 1, at[low]), (2 * node + 2, at[~low])]
        self.matrix = np.array(self.ways, np.float32) if self.ways else np.zeros((0, data.shape[1]), np.float32)

    def leaves(self, data: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(data), np.int64)
        todo = [(0, np.arange(len(data)))]
        while todo:
            node, at = todo.pop()
            if node not in self.cut or not len(at):
                out[at] = node
                continue
            way, cut = self.cut[node]
            low = data[at] @ self.matrix[way] < cut
            todo += [(2 * node + 1, at[low]), (2 * node + 2, at[~low])]
        return out


def search(trees: list[Tree], query: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the best leaves of the whole forest."""
    shadows = [t.matrix @ query for t in trees]
    queue = [(-np.inf, i, 0) for i in range(len(trees))]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    while queue and len(out) < visits:
        worst, i, node = heapq.heappop(queue)
        margin = -worst
        cuts, shadow = trees[i].cut, shadows[i]
        while node in cuts:
            way, cut = cuts[node]
            gap = float(shadow[way]) - cut
            near, far = (2 * node + 2, 2 * node + 1) if gap >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (-min(margin, -abs(gap)), i, far))
            node = near
        out.append((i, node))
    return out


def forest(sample: np.ndarray, leaf: int, trees: int = TREES) -> list[Tree]:
    return [Tree(sample, leaf, np.random.default_rng(SEED + i)) for i in range(trees)]


def visits_for(trees: list[Tree], sample: np.ndarray, k: int) -> int:
    """Leaves to visit for a recall of TARGET, measured against brute force over the sample."""
    asked = np.linspace(0, len(sample) - 1, min(TUNED_ON, len(sample))).astype(int)
    near = sample[asked, :-1].astype(np.float64) @ sample[:, :-1].T.astype(np.float64)
    near[np.arange(len(asked)), asked] = -np.inf
    m = min(k, len(sample) - 1)
    if m < 1:
        return len(trees)
    truth = np.argpartition(-near, m - 1, axis=1)[:, :m]
    homes = np.stack([t.leaves(sample) for t in trees])
    all_leaves = sum(len(t.cut) + 1 for t in trees)
    walks = [search(trees, np.append(sample[a, :-1], np.float32(0)), all_leaves) for a in asked]
    places = [{leaf: n for n, leaf in enumerate(w)} for w in walks]
    # For each true neighbour the number of visits after which it is found.
    needs = np.array([min(p[(i, int(homes[i, j]))] for i in range(len(trees))) for p, row in zip(places, truth) for j in row]) + 1
    return int(min(all_leaves, np.ceil(np.quantile(needs, TARGET)) + 1))


def thinned(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, with ties at the end; each class once."""
    o = np.lexsort((c, -s, q))
    q, c, s = q[o], c[o], s[o]
    new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]
    q, c, s = q[new], c[new], s[new]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = place < k
    return q[keep], c[keep], s[keep]


def widen(v: np.ndarray, most: float) -> np.ndarray:
    """One more component, after which all rows have norm ``most``."""
    rest = np.sqrt(np.maximum(0.0, most**2 - (v.astype(np.float64) ** 2).sum(1)))
    return np.column_stack([v, rest]).astype(np.float32)


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "float" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    rows = rows.where(ok).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast(kind)).alias("v"))
    again = settle(rows.groupBy("id").count().where("count > 1").select("id"))  # only ids move, and repeated ids' vectors
    least = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    rows = rows.join(again, "id", "left_anti").union(least)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (dims[0].d if dims else 0))


HITS = "qid bigint, cid bigint, score double"


def nearest(rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", visits: int | None = None, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k nearest rows found."""
    spark = rows.sparkSession
    usable = _usable(rows, key, vector)
    kind = f"leaf bigint, q boolean, id bigint, v {usable.schema['v'].dataType.simpleString()}"
    by = Window.partitionBy("v").orderBy("id")
    least = usable.distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    classes = settle(least.groupBy("v").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    n, most = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    most = float(np.sqrt(most)) * (1 + 1e-6)
    got = classes.orderBy(F.xxhash64("cid"), "cid").limit(FIT_ROWS).select("v").toArrow()
    sample = widen(_matrix(got["v"].combine_chunks()), most)
    own = forest(sample, max(2, min(LEAF, round(LEAF * len(sample) / n))), trees)
    visits = visits or visits_for(own, sample, k)
    model = spark.sparkContext.broadcast((own, most))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, most = model.value
        for b in slices(batches, 1024):
            data = widen(_matrix(b.column(1)), most)
            for i, t in enumerate(own):
                yield pa.RecordBatch.from_arrays([pa.array(t.leaves(data) * trees + i), pa.array(np.zeros(b.num_rows, bool)), b.column(0), b.column(1)], names=["leaf", "q", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = model.value
        for b in slices(batches, 64):
            data = _matrix(b.column(1))
            at, leaf = [], []
            for j, v in enumerate(np.column_stack([data, np.zeros(len(data), np.float32)])):
                for i, node in search(own, v, visits):
                    at.append(j)
                    leaf.append(node * trees + i)
            if at:
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(np.ones(len(at), bool)), b.column(0).take(take), b.column(1).take(take)], names=["leaf", "q", "id", "v"])

    asked = usable.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"]).select("id", "v")
    both = map_arrow(classes.select(F.col("cid").alias("id"), "v"), index, kind).union(map_arrow(asked, probe, kind))
    dealt = both.repartition(shuffle_width(spark), "leaf").sortWithinPartitions("leaf", "q", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, parts, ids, data = None, [], None, None
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in slices(batches, 4096):
            leaves, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (leaves[1:] != leaves[:-1]) | (asks[1:] != asks[:-1])])
            for s, e in zip(edges, np.r_[edges[1:], len(leaves)]):
                if leaves[s] != leaf:
                    leaf, parts, ids, data = leaves[s], [], None, None
                part = b.slice(s, e - s)
                if not asks[s]:
                    parts.append((part.column(2).to_numpy(), _matrix(part.column(3), np.float64)))
                    continue
                if ids is None:
                    if not parts:
                        continue
                    ids, data = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    q = _matrix(some.column(3), np.float64)
                    scores = q @ data.T
                    m = min(k + 1, len(ids))
                    cut = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
                    i, j = np.nonzero(scores >= cut[:, None] - 1e-9)  # with ties at the cut
                    found.append((some.column(2).to_numpy()[i], ids[j], (q[i] * data[j]).sum(1)))
                    held += len(i)
                if held > HELD:
                    found = [thinned(*(np.concatenate(x) for x in zip(*found)), k + 1)]
                    held = len(found[0][0])
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["qid", "cid", "score"])
                        found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in thinned(*(np.concatenate(x) for x in zip(*found)), k + 1)], names=["qid", "cid", "score"])

    hits = map_arrow(dealt, meet, HITS).groupBy("qid", "cid").agg(F.max("score").alias("score"))
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    hits = hits.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    named = hits.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id")).where("qid <> vec_id")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")
