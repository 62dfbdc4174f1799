"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives every document a posterior over the domains clean,
junk and toxic.  Nonnegative rates for the documents are then fitted by projected gradient descent on
least squares, so that each domain's expected tokens, sum of rate * tokens * posterior, match the targets.

A rate depends only on its document's posterior and on the residuals of the rounds so far, so each round is
one aggregate of as many numbers as there are domains, and the rates are a column expression: nothing
is kept per document between rounds, and a lost executor loses nothing.

The classifier is a softmax regression over word presence and a few shape features, fitted on at most
``toxicity.BOUND`` rows of each combination of labels.  Scoring, totals and rates cover all rows and whole texts.

Defined results: null and empty texts have no tokens, the posterior of an empty text, and a rate like
others; they never change the totals.  A domain without labelled rows has posterior 0; without any
labels all documents are clean.  Rows are neither dropped nor merged by ``rates``: repeated rows and null
keys have rates of their own, and an empty table gives none.  Other columns of ``docs``, whatever their names,
are not read; long texts are read whole.  Rounds end when the residuals are still; ``miss`` tells what is left.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, mix_hash, settle, slices, trim
from tsuzuri.llm.toxicity import Index, features

DOMAINS = ("clean", "junk", "toxic")
WORDS = 300
#: Rounds of one column expression; then the rates so far are written down.
ROUNDS = 15
#: Written stages; each has ``ROUNDS`` rounds.
STAGES = 12
#: Rounds end when no domain's relative residual moves by more.
STILL = 1e-4
L2 = 1e-4


def domain(labels: tuple[int, ...]) -> int:
    bad, toxic = labels
    return 2 if toxic else 1 if bad else 0


#: Characters up to this place are classed by a table, later ones singly.
TABLED = 0x32000
LETTER, UPPER, SPACE, ALNUM, BAR = 1, 2, 4, 8, 16


def _kind(c: str) -> int:
    return LETTER * c.isalpha() | UPPER * c.isupper() | SPACE * c.isspace() | ALNUM * c.isalnum() | BAR * (c == "|")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.fromiter((_kind(chr(i)) for i in range(TABLED)), np.uint8, TABLED)


def shape(text: str | None, distinct: int | None = None) -> tuple[list[float], int]:
    """Shares that tell prose from junk, between 0 and 1; and the number of white-space words."""
    t = text or ""
    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if not n:
        return [0.0, 1.0, 0.0, 1.0, min(1.0, math.log(2) / 5), 0.0], 0
    kinds = _kinds()[np.minimum(code, TABLED - 1)]
    for i in np.flatnonzero(code >= TABLED):
        kinds[i] = _kind(chr(code[i]))
    count = lambda bit: int(np.count_nonzero(kinds & bit))
    letters, upper, space, bars = count(LETTER), count(UPPER), count(SPACE), count(BAR)
    free = (kinds & SPACE) == 0
    ends = free.copy()
    ends[:-1] &= ~free[1:]
    words = int(np.count_nonzero(ends))
    if distinct is None:
        distinct = len(set(t.split()))
    share = distinct / words if words else 1.0
    usual = share * math.log(words + 2)  # distinct words fall as texts grow
    odd = int(np.count_nonzero(ends & ((kinds & ALNUM) == 0)))
    return [upper / max(1, letters), 1 - (letters + space) / n, bars / max(1, words), share, min(1.0, usual / 5), odd / max(1, words)], words


SHAPES = 6


@dataclass
class Domains:
    index: Index
    weights: np.ndarray | None  # (features + shapes + 1, domains)
    live: list[int]

    def posterior(self, text: str | None) -> tuple[np.ndarray, int]:
        """Shares of the domains, and the number of white-space words."""
        out = np.zeros(len(DOMAINS))
        tokens = set((text or "").split())
        form, words = shape(text, len(tokens))
        if self.weights is None:
            out[self.live[0] if self.live else 0] = 1.0
            return out, words
        n = len(self.index)
        z = self.weights[self.index.hits(tokens)].sum(0) + np.asarray(form) @ self.weights[n:-1] + self.weights[-1]
        e = np.exp(z - z.max())
        out[self.live] = e / e.sum()
        return out, words


def fit_domains(rows: list[tuple[str | None, tuple[int, ...]]], steps: int = 400) -> Domains:
    y = np.array([domain(r[1]) for r in rows], int)
    live = sorted(set(y.tolist()))
    if len(live) < 2:
        return Domains(Index([]), None, live)
    counts: Counter[str] = Counter()
    for r in rows:
        counts.update(f for f in features(r[0]) if f[0] != "^" or len(f) < 7)
    names = sorted(f for f, k in counts.items() if k >= 5)
    index, n = {f: i for i, f in enumerate(names)}, len(rows)
    total = np.array([counts[f] for f in names], float)
    counts.clear()
    seen = np.zeros((len(DOMAINS), len(names)))
    for r, d in zip(rows, y):
        if d:
            seen[d, [index[f] for f in features(r[0]) if f in index]] += 1
    seen[0] = total - seen.sum(0)
    best = np.zeros(len(names))
    for d in live:
        p = (y == d).sum()
        best = np.maximum(best, (seen[d] - total * p / n) ** 2 / np.maximum(1e-9, total * (n - total) * p * (n - p) / n**3))
    chosen = sorted(names[i] for i in np.lexsort((np.arange(len(names)), -best))[:WORDS])
    own = Index(chosen)
    x = np.zeros((n, len(own) + SHAPES), np.float32)
    for i, r in enumerate(rows):
        tokens = set((r[0] or "").split())
        x[i, own.hits(tokens)] = 1
        x[i, len(own) :] = shape(r[0], len(tokens))[0]
    x = np.column_stack([x, np.ones(n, np.float32)])
    t = (y[:, None] == np.array(live)).astype(np.float32)
    share = t.mean(0)  # every domain has the same weight in the fit, as the sample is balanced by label
    w, v, rate = np.zeros((x.shape[1], len(live)), np.float32), np.zeros((x.shape[1], len(live)), np.float32), 2.0 / max(1.0, float((x * x).sum(1).mean()))
    rate *= 4
    weight = (t / share / len(live)).sum(1, keepdims=True) / n
    for step in range(steps):
        ahead = w + step / (step + 3) * v
        z = x @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        new = ahead - rate * (x.T @ (weight * (e / e.sum(1, keepdims=True) - t)) + L2 * ahead)
        v, w = new - w, new
    return Domains(own, w.astype(float), live)


def memberships(docs: DataFrame, model: Domains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens (white-space words) and p_<domain>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS features
    names = [f"p_{d}" for d in DOMAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            got = [m.posterior(t) for t in b.column(1).to_pylist()]
            p = np.array([g[0] for g in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[1] for g in got], pa.int64()), *(pa.array(p[:, j]) for j in range(len(DOMAINS)))], names=[key, "n_tokens", *names])
        trim()

    return map_arrow(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, " + ", ".join(f"{c} double" for c in names))


def rates(members: DataFrame, targets: dict[str, float], base: str | None = None, keep: str | None = None, most: float | None = None) -> DataFrame:
    """``members`` with ``rate``, and in ``miss`` the largest relative distance of a domain's tokens from its target.

    The distance is 0 or nearly so where the targets can be met; bounds (``keep``, ``most``) and a lack of a
    domain's tokens leave more, which the column shows.      Targets are shares of the total; the total is that of all tokens, or, with ``base``, the one at which
    that domain's own tokens are just enough.  With ``keep``, documents that are likelier than not in
    that domain have a rate of at least 1; ``most`` bounds all rates.
    """
    p = {d: F.col(f"p_{d}") for d in DOMAINS}
    sums = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * p[d]), F.lit(0.0)).alias(d) for d in DOMAINS]).first().asDict()
    weight = {d: targets.get(d, 0.0) / sum(targets.values()) for d in DOMAINS}
    total = sums[base] / weight[base] if base and weight[base] else sum(sums.values())
    goal = {d: weight[d] * total for d in DOMAINS}
    low = F.when(p[keep] >= 0.5, 1.0).otherwise(0.0) if keep else F.lit(0.0)

    def held(r: Column) -> Column:
        r = F.greatest(r, low)
        return F.least(r, F.lit(float(most))) if most is not None else r

    own, rate, before = members, F.lit(1.0), None
    for i in range(STAGES * ROUNDS):
        got = own.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * p[d]), F.lit(0.0)).alias(d) for d in DOMAINS]).first().asDict()
        residual = {d: (got[d] - goal[d]) / sums[d] if sums[d] > 0 else 0.0 for d in DOMAINS}
        now = [residual[d] for d in DOMAINS]
        if max(map(abs, now)) < STILL or before and max(abs(a - b) for a, b in zip(now, before)) < STILL:
            break
        before = now
        slope = sum((p[d] * F.lit(float(residual[d])) for d in DOMAINS[1:]), p[DOMAINS[0]] * F.lit(float(residual[DOMAINS[0]])))
        rate = held(rate - slope)
        if i % ROUNDS == ROUNDS - 1:
            own, rate = settle(own.withColumn("rate", rate)), F.col("rate")
    gap = {d: got[d] / goal[d] - 1 if goal[d] else got[d] for d in DOMAINS}
    worst = max(abs(g) for g in gap.values())
    return own.withColumn("rate", rate).withColumn("miss", F.lit(float(worst)))


def copies(rate: Column, key: str = "doc_id") -> Column:
    """Whole copies whose expectation is the rate, the same in every run."""
    return F.floor(rate + mix_hash(key, salt=10)).cast("int")


def report(docs: DataFrame, model: Domains, targets: dict[str, float]) -> DataFrame:
    members = settle(memberships(docs, model))
    return rates(members, targets).withColumn("copies", copies(F.col("rate")))
