"""Toxicity by a classifier chain of linear models.

The chain's categories are predicted in order.  Each model is a logistic regression over the words of
a text, and over the probabilities of the categories before it.  For training, those probabilities are
out-of-fold predictions, so that a later model sees them as uncertain as they will be on new texts.
``labels`` marks two categories, low quality and toxic, which form the chain of the query: low quality
first, as junk text changes which words a toxic text holds.  The decision is the last category's
probability against the threshold that has the best out-of-fold F1.

Features are the presence of lower-cased words (``\\w+``) and of their beginnings of 4 to 7 letters,
for inflected words; of them, the ``FEATURES`` with the largest chi-square for any category are kept.

Fitting uses at most ``BOUND`` labelled rows of each combination of labels, in the order of a hash of
the key.  Scoring uses every row and its whole text.

Defined results: null and empty texts have no features and get the models' base rates.  Without
labels, or with one value only, a category's probability is its share of labelled rows (0 without any).
Rows are neither dropped nor merged by ``score``: repeated rows and rows with a null key have results of
their own, and an empty table has none.  Labels with a null key or a null or other value are not used; of
conflicting labels of a key the smallest (low quality, toxic) counts.  Long texts are read whole.  A
probability at the threshold is toxic.  Columns named like the new ones are replaced by ``score`` and kept by
``without_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, slices, spare, trim

CATEGORIES = ("low_quality", "toxic")
BOUND = 1500
FEATURES = 600
FOLDS = 3
HEADS = range(4, 8)
L2 = 2e-4
WORD = re.compile(r"\w+")


def words_of(tokens: Iterable[str]) -> set[str]:
    """Lower-cased words (``\\w+``) of white-space tokens; no word crosses white space."""
    return set(WORD.findall(" ".join(tokens).lower()))


def features(text: str | None) -> set[str]:
    words = words_of(set((text or "").split()))
    return words | {"^" + w[:k] for w in words for k in HEADS if len(w) >= k}


class Index:
    """Places of known features; a word is looked up only as far as features begin with its first four letters."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.whole = {f: i for i, f in enumerate(names) if f[0] != "^"}
        self.heads = {f[1:]: i for i, f in enumerate(names) if f[0] == "^"}
        self.ways: dict[str, tuple[int, ...]] = {}  # lengths of the heads by first letters; 0 stands for the whole word
        for f in names:
            own, k = (f, 0) if f[0] != "^" else (f[1:], len(f) - 1)
            self.ways[own[:4]] = tuple(sorted({*self.ways.get(own[:4], ()), k}))

    def __len__(self) -> int:
        return len(self.names)

    def hits(self, tokens: Iterable[str]) -> list[int]:
        whole, heads, ways, out = self.whole.get, self.heads.get, self.ways, set()
        low = " ".join(tokens).lower().split(" ")
        parts = WORD.findall(" ".join([w for w in low if not w.isalnum()]))
        for w in [w for w in low if w[:4] in ways and w.isalnum()] + [w for w in parts if w[:4] in ways]:
            for k in ways[w[:4]]:
                out.add(heads(w[:k]) if k else whole(w))
        out.discard(None)
        return sorted(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights and offset (last) of an L2 logistic regression with equal weight for both labels."""
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    beta, offset = np.zeros(x.shape[1], np.float32), 0.0
    vel, vel0 = np.zeros_like(beta), 0.0
    rate = 4.0 / max(1.0, float((w @ (x * x)).sum() + 1))
    rate = max(rate, 0.2)
    for t in range(steps):
        mom = t / (t + 3)
        ahead, ahead0 = beta + mom * vel, offset + mom * vel0
        g = w * (_sigmoid(x @ ahead + ahead0) - y)
        new, new0 = ahead - rate * (x.T @ g + L2 * ahead), ahead0 - rate * float(g.sum())
        vel, vel0, beta, offset = new - beta, new0 - offset, new, new0
    return np.append(beta, offset)


@dataclass
class Chain:
    categories: tuple[str, ...]
    index: Index
    weights: list[np.ndarray]
    threshold: float
    shares: list[float]

    def probabilities(self, text: str | None) -> list[float]:
        at, out = self.index.hits(set((text or "").split())), []
        for share, w in zip(self.shares, self.weights):
            if w is None:
                out.append(share)
                continue
            n = len(self.index)
            z = w[-1] + w[at].sum() + sum(w[n + j] * p for j, p in enumerate(out))
            out.append(float(_sigmoid(z)))
        return out


def fit_chain(rows: list[tuple[str | None, tuple[int, ...]]], categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """The chain from (text, labels) rows; a row's fold is its place in the list."""
    y = np.array([r[1] for r in rows], np.float32).reshape(len(rows), len(categories))
    shares = [float(v) for v in y.mean(0)] if len(rows) else [0.0] * len(categories)
    live = [0 < s < 1 for s in shares]
    if not any(live):
        return Chain(categories, Index([]), [None] * len(categories), 0.5, shares)
    counts: Counter[str] = Counter()  # the features are made twice rather than held for all rows
    for r in rows:
        counts.update(features(r[0]))
    names, n = sorted(f for f, k in counts.items() if k >= 5), len(rows)
    total = np.array([counts[f] for f in names], float)
    counts.clear()
    index = {f: i for i, f in enumerate(names)}
    both = np.zeros((len(categories), len(index)))
    for r, v in zip(rows, y):
        if v.any():
            both[:, [index[f] for f in features(r[0]) if f in index]] += v[:, None]
    best = np.zeros(len(index))
    for j in range(len(categories)):
        p = y[:, j].sum()
        expected = total * p / n
        seen = both[j]
        chi = (seen - expected) ** 2 * n**2 / np.maximum(1e-9, total * (n - total) * p * (n - p) / n) if live[j] else 0 * total
        best = np.maximum(best, chi)
    chosen = sorted(names[i] for i in np.lexsort((np.arange(len(names)), -best))[:FEATURES])
    own = Index(chosen)
    x = np.zeros((n, len(own)), np.float32)
    for i, r in enumerate(rows):
        x[i, own.hits(set((r[0] or "").split()))] = 1
    fold, weights, before = np.arange(n) % FOLDS, [], np.zeros((n, 0), np.float32)
    for j in range(len(categories)):
        if not live[j]:
            weights.append(None)
            before = np.column_stack([before, np.full(n, shares[j], np.float32)])
            continue
        full = np.column_stack([x, before])
        out = np.zeros(n, np.float32)
        for k in range(FOLDS):
            inside = fold != k
            b = fit_linear(full[inside], y[inside, j])
            out[~inside] = _sigmoid(full[~inside] @ b[:-1] + b[-1])
        weights.append(fit_linear(full, y[:, j]))
        before = np.column_stack([before, out])
    return Chain(categories, own, weights, best_threshold(before[:, -1], y[:, -1]), shares)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of 0.30, 0.35, ... 0.70 the one with the best F1; of equal ones the nearest to 0.5."""

    def f1(t: float) -> float:
        said = p >= t
        return 2 * float((said & (y == 1)).sum()) / max(1, said.sum() + (y == 1).sum())

    return max((round(0.05 * i, 2) for i in range(6, 15)), key=lambda t: (round(f1(t), 6), -abs(t - 0.5)))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> list[tuple[str | None, tuple[int, ...]]]:
    """At most ``bound`` labelled texts of each combination of labels; of repeated keys the smallest labels and text."""
    known = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min(F.struct((1 - F.col("quality")).cast("int").alias("bad"), F.col("toxic").cast("int").alias("toxic"))).alias("y"))
    known = known.select("doc_id", "y.bad", "y.toxic", F.xxhash64("doc_id").alias("h"))
    chosen = [r for b in (0, 1) for t in (0, 1) for r in known.where((F.col("bad") == b) & (F.col("toxic") == t)).orderBy("h", "doc_id").limit(bound).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, bad int, toxic int, h long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 4 * bound keys
    rows = rows.groupBy("doc_id", "bad", "toxic", "h").agg(F.min("text").alias("text")).collect()
    return [(r.text, (r.bad, r.toxic)) for r in sorted(rows, key=lambda r: (r.h, r.doc_id))]


def score(docs: DataFrame, chain: Chain, text: str = "text", flag: str = "is_toxic", only: bool = False) -> DataFrame:
    """``docs`` with a column p_<category> for each category and the boolean ``flag``.

    Other columns stay; columns of the same names are replaced.  With ``only``, there is no p_<category>.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights for each category
    names = [] if only else [f"p_{c}" for c in chain.categories]
    new = {n.lower() for n in (*names, flag)}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in new])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            p = [m.probabilities(t) for t in b.column(at).to_pylist()]
            more = [pa.array([v[j] for v in p], pa.float64()) for j in range(len(names))]
            said = pa.array([v[-1] >= m.threshold for v in p], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *more, said], names=[*b.schema.names, *names, flag])
        trim()

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{c} double" for c in names), f"`{flag}` boolean"])
    return map_arrow(kept, run, kinds)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = fit_chain(training_rows(docs, labels))
    return score(docs.select("doc_id", "text"), chain).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic; columns as they were."""
    chain = fit_chain(training_rows(docs, labels))
    flag = spare(docs.columns, "is_toxic")
    return score(docs, chain, flag=flag, only=True).where(~F.col(flag)).drop(flag)
