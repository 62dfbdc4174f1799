"""Quality classifier by compression: two zstandard dictionaries and a calibrated size difference.

A dictionary of good and one of bad text are built from labelled rows.  A text is cut into blocks of
``BLOCK`` bytes; each block is compressed with either dictionary, and the sizes are summed over the
whole text.  The normalised difference (bad - good) / (bad + good) is positive where the good
dictionary helps more.  A logistic curve over it, fitted on labelled rows that are in neither
dictionary, turns it into a score from 0 to 1.

Fitting uses at most ``PER_CLASS`` rows of each label, in the order of a hash of the key, and all blocks
of their texts for a dictionary of ``DICT_BYTES``; scoring uses every row and its whole text.

Defined results: null and empty texts get the curve's value at a difference of 0.  If one label is
missing, every score is the share of good labels (0.5 without labels).  Rows are neither dropped nor merged:
repeated rows and null keys (never held out) have scores of their own, and an empty table none.  Labels with a null
key or another value than 0 and 1 are not used; of conflicting labels of a key the bad one counts, and of
repeated keys the smallest text is learned from.  Columns other than key and text are not read.  Fewer than 200 blocks of a
label are too few to train a dictionary on; then their last ``DICT_BYTES`` are the dictionary as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, slices, trim

PER_CLASS = 1500
DICT_BYTES = 64 << 10
BLOCK = 1 << 10
LEVEL = 3
#: Of the fitted rows, one in CALIBRATE is kept for the curve.
CALIBRATE = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float

    def score(self, text: str | None) -> float:
        if not self.good or not self.bad:
            return self.prior
        z = self.slope * difference(text, self.good, self.bad) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


@lru_cache(maxsize=4)
def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    data = (text or "").encode()
    if not data:
        return 0.0
    g, b = _compressor(good).compress, _compressor(bad).compress
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    x, y = sum(len(g(p)) for p in blocks), sum(len(b(p)) for p in blocks)
    return (y - x) / (y + x)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the raw end of the texts where they are too few to train on."""
    blocks = [d[i : i + BLOCK] for d in (t.encode() for t in texts) for i in range(0, len(d), BLOCK)]
    if len(blocks) >= 200:
        try:
            return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
        except zstandard.ZstdError:  # samples too alike
            pass
    return b"\n".join(blocks)[-DICT_BYTES:]


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Dictionaries and curve from (text, label) rows; the rows' order decides which ones calibrate."""
    build = [r for i, r in enumerate(rows) if i % CALIBRATE and r[0]]
    tune = [r for i, r in enumerate(rows) if i % CALIBRATE == 0 and r[0]]
    good, bad = ([t for t, y in build if y == k] for k in (1, 0))
    prior = float(np.mean([y for _, y in rows])) if rows else 0.5
    if not good or not bad or len({y for _, y in tune}) < 2:
        return Model(b"", b"", 0.0, 0.0, prior)
    a, b = _dictionary(good), _dictionary(bad)
    x = np.array([difference(t, a, b) for t, _ in tune])
    y = np.array([v for _, v in tune], float)
    # Equal weight for both labels, so that 0.5 is where either is as likely.
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    scale = x.std() or 1.0
    m = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        grad = m.T @ (w * (p - y)) + 1e-3 * beta
        hess = (m * (w * p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
        beta -= np.linalg.solve(hess, grad)
    return Model(a, b, float(beta[0] / scale), float(beta[1]), prior)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[str | None, int]]:
    """At most ``per_class`` labelled texts of each class whose key is not held out, in a fixed order."""
    known = labels.select("doc_id", F.col("quality").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.y, r.h) for r in chosen], "doc_id long, y int, h long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * per_class keys
    rows = rows.groupBy("doc_id", "y", "h").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.h, r.doc_id))]


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=[key, "score"])
        trim()

    return map_arrow(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs, fit(training_rows(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
