"""Corpus statistics over matches: counts, association, contingency, keyness, correspondence analysis."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsuzuri.operators.lexicon import CONNECTIVE, FINAL
from tsuzuri.sources.store import once

TINY = 1e-12
#: Cells of a table that the driver takes.
MOST_CELLS = 4_000_000
#: Cells of a dense table.
MOST_DENSE = 1_000_000_000


def count_by(df: DataFrame, by: Sequence[str] = ("type", "genre1", "func", "subfunc", "expr")) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("freq")).orderBy(*by, F.desc("freq"))


def summarize_by_file(sections: DataFrame) -> DataFrame:
    first = F.min_by(F.col("text"), F.struct("section", "text"))
    return sections.groupBy("basename").agg(F.count("*").alias("n_sections"), F.count_if(F.col("section") == "unknown").alias("n_unknown"), first.alias("example_text")).withColumn("unknown_ratio", F.col("n_unknown") / F.col("n_sections"))


def find_problematic(summary: DataFrame, min_sections: int = 2, min_ratio: float = 0.6, top: int = 200) -> DataFrame:
    bad = summary.where((F.col("n_sections") <= min_sections) | (F.col("unknown_ratio") >= min_ratio))
    return bad.withColumn("snippet", F.substring("example_text", 1, 320)).drop("example_text").orderBy(F.desc("unknown_ratio"), "n_sections", "basename").limit(max(0, top))


def min_positions(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return matches.groupBy(*by, "sentence_id", "type", "expr").agg(F.min("position").alias("position"))


def side_by_side(matches: DataFrame, conn: Sequence[Column], final: Sequence[Column]) -> DataFrame:
    """sentence_id and the columns of both sides, for each connective and final of the same sentence.

    The markers of a sentence are gathered in one pass, so ``matches`` is computed once; as in a join, a null id has no pairs.
    """
    kind = F.col("type")
    one = matches.where(F.col("sentence_id").isNotNull() & kind.isin(CONNECTIVE, FINAL)).groupBy("sentence_id")
    one = one.agg(F.collect_list(F.when(kind == CONNECTIVE, F.struct(*conn))).alias("__c"), F.collect_list(F.when(kind == FINAL, F.struct(*final))).alias("__f"))
    one = one.where((F.size("__c") > 0) & (F.size("__f") > 0))
    return one.select("sentence_id", F.explode("__c").alias("__c"), "__f").select("sentence_id", "__c", F.explode("__f").alias("__f")).select("sentence_id", "__c.*", "__f.*")


def pairs(matches: DataFrame, distinct: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Connective and final of the same sentence: conn, final, conn_pos, final_pos; with ``distinct``, once a sentence."""
    src = min_positions(matches, by) if distinct else matches
    ce = [*map(F.col, by), F.col("expr").alias("conn"), F.col("position").alias("conn_pos")]
    return side_by_side(src, ce, [F.col("expr").alias("final"), F.col("position").alias("final_pos")])


def pmi_entropy(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """conn, final, joint, pmi, transition, conn_entropy, final_entropy; ``by`` columns are leading keys (nulls are a group).

    One pairs join; marginals come from grouped counts of distinct (sentence, expression) rows.
    """
    least = min_positions(matches, by)
    joint = pairs(matches, True, by).groupBy(*by, "conn", "final").agg(F.count("*").alias("joint"), F.count_if(F.col("conn_pos") < F.col("final_pos")).alias("ahead"))
    total = least.groupBy(*by).agg(F.countDistinct("sentence_id").alias("sentences"))
    single = least.groupBy(*by, "type", "expr").agg(F.count("*").alias("n"))

    def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
        cond = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
        out = left.join(renamed, cond, "left") if cond else left.crossJoin(F.broadcast(renamed))  # without keys: one row
        return out.drop(*[f"__{k}" for k in keys])

    out = beside(joint, total, list(by))
    out = beside(out, single.where(F.col("type") == CONNECTIVE).select(*by, F.col("expr").alias("conn"), F.col("n").alias("n_conn")), [*by, "conn"])
    out = beside(out, single.where(F.col("type") == FINAL).select(*by, F.col("expr").alias("final"), F.col("n").alias("n_final")), [*by, "final"])
    p = lambda c: F.col(c) / F.col("sentences")
    out = out.withColumn("pmi", F.log2(p("joint") / (p("n_conn") * p("n_final")))).withColumn("transition", F.col("ahead") / F.col("n_conn"))
    for side in ("conn", "final"):
        w = Window.partitionBy(*by, side)
        share = F.col("joint") / F.sum("joint").over(w)
        out = out.withColumn("__p", share).withColumn(f"{side}_entropy", F.sum(-F.col("__p") * F.log2("__p")).over(w) + 0.0).drop("__p")
    return out.select(*by, "conn", "final", "joint", "n_conn", "n_final", "sentences", "pmi", "transition", "conn_entropy", "final_entropy")


def contingency(df: DataFrame, cat: str | Sequence[str], expr: str = "expr", wide: bool = False) -> DataFrame:
    """Counts by category and expression; several category columns are joined by `` / ``; missing cells only appear in the wide form."""
    cats = [cat] if isinstance(cat, str) else list(cat)
    key = F.col(cats[0]) if len(cats) == 1 else F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cats])
    rows = df.select(key.alias("cat"), F.col(expr).alias("expr"))
    if wide:
        return rows.groupBy("cat").pivot("expr").count().na.fill(0)
    return rows.groupBy("cat", "expr").agg(F.count("*").alias("n"))


def dense(table: DataFrame) -> DataFrame:
    """All cells (cat, expr, n) of a contingency table with its margins: row, col, total; cells without rows have 0.

    Both sides of the product are margins: distinct categories and expressions; a product of more than
    ``MOST_DENSE`` cells raises, and ``table`` itself then has all that is not zero.  The counts are read
    several times, so they are written once.
    """
    table = once(table)
    size = table.agg(F.countDistinct("cat").alias("c"), F.countDistinct("expr").alias("e")).first()
    if size.c * size.e > MOST_DENSE:
        raise ValueError(f"{size.c} categories x {size.e} expressions are too many cells")
    rows = table.groupBy("cat").agg(F.sum("n").alias("row"))
    cols = table.groupBy("expr").agg(F.sum("n").alias("col"))
    total = table.agg(F.sum("n").alias("total"))
    cells = rows.crossJoin(cols).crossJoin(F.broadcast(total))
    return cells.join(table, ["cat", "expr"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def chi2_residuals(table: DataFrame) -> DataFrame:
    e = F.col("row") * F.col("col") / F.col("total")
    return dense(table).withColumn("expected", e).withColumn("residual", (F.col("n") - e) / F.sqrt(e + TINY))


def chi2_summary(table: DataFrame) -> DataFrame:
    """chi2, dof, n, cramers_v in one row; below 2 x 2: 0, 0, n, 0."""
    r = chi2_residuals(table)
    s = r.agg(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / (F.col("expected") + TINY)).alias("x"), F.countDistinct("cat").alias("r"), F.countDistinct("expr").alias("c"), F.max("total").alias("n"))
    small = (F.col("r") < 2) | (F.col("c") < 2)
    return s.select(
        F.when(small, 0.0).otherwise(F.col("x")).alias("chi2"),
        F.when(small, 0).otherwise((F.col("r") - 1) * (F.col("c") - 1)).cast("long").alias("dof"),
        F.col("n").alias("n"),
        F.when(small, 0.0).otherwise(F.sqrt(F.col("x") / F.col("n") / F.greatest(F.least("r", "c") - 1, F.lit(1)))).alias("cramers_v"),
    )


def chi2_sf(x: float, dof: int) -> float:
    """Survival function of chi-square: regularised upper incomplete gamma function."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, h = dof / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * front)
    b, c, d = h + 1 - a, 1e300, 1 / (h + 1 - a)
    f = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def p_of_llr(x):
    return x.map(lambda v: math.erfc(math.sqrt(max(0.0, v) / 2)))


def adjust(df: DataFrame, p: Column, method: str | None = "fdr_bh") -> DataFrame:
    """p_adj: Benjamini-Hochberg by a reverse running minimum, Bonferroni, or none."""
    df = df.withColumn("__p", p)
    if method is None:
        return df.withColumn("p_adj", F.col("__p")).drop("__p")
    m = df.groupBy().agg(F.count("*").alias("__m"))
    df = df.crossJoin(F.broadcast(m))  # one row
    if method == "bonferroni":
        return df.withColumn("p_adj", F.least(F.lit(1.0), F.col("__p") * F.col("__m"))).drop("__p", "__m")
    if method != "fdr_bh":
        raise ValueError(f"unknown correction {method}")
    rank = Window.orderBy("__p")  # one row for each expression of the lexicon
    down = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__r", F.row_number().over(rank)).withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col("__p") * F.col("__m") / F.col("__r")).over(down)))
    return df.drop("__p", "__m", "__r")


def llr_keyness(df: DataFrame, target: str, cat: str = "section", expr: str = "expr", min_count: int = 5, correction: str | None = "fdr_bh") -> DataFrame:
    """expr, a, b, n1, n2, llr, target_rel, p, p_adj: log-likelihood keyness of a category against the rest."""
    inside = F.col(cat) == target
    counts = df.groupBy(F.col(expr).alias("expr")).agg(F.count_if(inside).alias("a"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("b"))
    totals = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    t = counts.crossJoin(F.broadcast(totals)).where(F.col("a") + F.col("b") >= min_count)  # totals: one row
    both, n = F.col("a") + F.col("b"), F.col("n1") + F.col("n2")
    part = lambda o, e: F.when(F.col(o) > 0, F.col(o) * F.ln(F.col(o) / (e + TINY))).otherwise(0.0)
    llr = 2 * (part("a", both * F.col("n1") / n) + part("b", both * F.col("n2") / n))
    rel = F.col("a") / F.greatest("n1", F.lit(1)) - F.col("b") / F.greatest("n2", F.lit(1))
    t = t.withColumn("llr", llr).withColumn("target_rel", rel).withColumn("p", p_of_llr("llr"))
    return adjust(t, F.col("p"), correction)


def keyness_by_category(df: DataFrame, cat: str = "section", expr: str = "expr", min_count: int = 5) -> DataFrame:
    """cat, expr, a, b, llr, target_rel of every category against the rest, from one grouped count."""
    n = df.where(F.col(cat).isNotNull()).groupBy(F.col(cat).alias("cat"), F.col(expr).alias("expr")).agg(F.count("*").alias("a"))
    every = df.groupBy(F.col(expr).alias("expr")).agg(F.count("*").alias("both")).where(F.col("both") >= min_count)
    own = n.groupBy("cat").agg(F.sum("a").alias("n1"))
    whole = df.agg(F.count("*").alias("n"))  # one row
    t = n.join(every, "expr").join(own, "cat").crossJoin(F.broadcast(whole))
    t = t.withColumn("b", F.col("both") - F.col("a")).withColumn("n2", F.col("n") - F.col("n1"))
    part = lambda o, m: F.when(F.col(o) > 0, F.col(o) * F.ln(F.col(o) / (F.col("both") * F.col(m) / F.col("n") + TINY))).otherwise(0.0)
    rel = F.col("a") / F.greatest("n1", F.lit(1)) - F.col("b") / F.greatest("n2", F.lit(1))
    return t.select("cat", "expr", "a", "b", (2 * (part("a", "n1") + part("b", "n2"))).alias("llr"), rel.alias("target_rel"))


def top_characteristic(df: DataFrame, cats: Sequence[str], cat: str = "section", top: int = 5, min_count: int = 5) -> DataFrame:
    """rank x category table of the ``top`` over-represented expressions, as ``expr (llr)``."""
    rows = keyness_by_category(df, cat, min_count=min_count).where(F.col("cat").isin(*cats) & (F.col("target_rel") > 0))
    by = Window.partitionBy("cat").orderBy(F.desc("llr"), "expr")
    rows = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    cell = F.format_string("%s (%.1f)", F.col("expr"), F.col("llr"))
    return rows.groupBy("rank").pivot("cat", list(cats)).agg(F.first(cell)).na.fill("").orderBy("rank")


def over_under(keyness: DataFrame, top: int = 10, over: bool = True) -> DataFrame:
    """The ``top`` over- or under-represented expressions of a keyness table."""
    if over:
        return keyness.where("target_rel > 0").orderBy(F.desc("llr"), F.desc("target_rel"), "expr").limit(max(0, top))
    return keyness.where("target_rel < 0").orderBy(F.desc("llr"), "target_rel", "expr").limit(max(0, top))


def chi2_p(summary: DataFrame) -> DataFrame:
    """``chi2_summary`` with its p-value; 1 where there is no degree of freedom."""

    @F.pandas_udf("double")
    def upper(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi2_upper(float(a), int(k)) for a, k in zip(x, dof)])

    return summary.withColumn("p", upper("chi2", "dof"))


def chi2_upper(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    if dof < 1 or x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * scale)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def dominant_category(df: DataFrame, cat: str = "section", expr: str = "expr") -> DataFrame:
    n = df.groupBy(expr, cat).agg(F.count("*").alias("n"))
    return n.groupBy(F.col(expr).alias("expr")).agg(F.max_by(F.col(cat), F.struct("n", F.col(cat))).alias("category"), F.max("n").alias("n"))


def correspondence(table: DataFrame, axes: int = 2) -> tuple[DataFrame, DataFrame, list[float]]:
    """(row coordinates, column coordinates, inertias) of a contingency table whose margins fit the driver.

    The table holds one row for each category and expression of a lexicon; it is aggregated in Spark first, once.
    """
    table = once(table)
    size = table.agg(F.countDistinct("cat").alias("c"), F.countDistinct("expr").alias("e")).first()
    if size.c * size.e > MOST_CELLS:
        raise ValueError(f"correspondence analysis of {size.c} x {size.e} cells does not fit the driver")
    rows = table.collect()  # MOST_CELLS at most
    cats, exprs = sorted({r.cat for r in rows}), sorted({r.expr for r in rows})
    if len(cats) < 2 or len(exprs) < 2:
        raise ValueError("correspondence analysis needs two categories and two expressions")
    m = np.zeros((len(cats), len(exprs)))
    ci, ei = {c: i for i, c in enumerate(cats)}, {e: i for i, e in enumerate(exprs)}
    for r in rows:
        m[ci[r.cat], ei[r.expr]] += r.n
    p = m / m.sum()
    a, b = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(a, b)) / np.sqrt(np.outer(a, b)), full_matrices=False)
    k = min(axes, len(cats) - 1, len(exprs) - 1)
    f, g = u[:, :k] * s[:k] / np.sqrt(a)[:, None], vt[:k].T * s[:k] / np.sqrt(b)[:, None]
    sign = np.where(f[np.abs(f).argmax(0), range(k)] < 0, -1.0, 1.0)
    f, g = f * sign, g * sign
    spark = table.sparkSession
    frame = lambda names, x: spark.createDataFrame([(n, *(float(v) for v in row), *[0.0] * (axes - k)) for n, row in zip(names, x)], "name string, " + ", ".join(f"dim_{i} double" for i in range(axes)))
    return frame(cats, f), frame(exprs, g), [float(v * v) for v in s[: min(len(cats), len(exprs)) - 1]]


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """(disparity, distance of each row) of two point sets after the best similarity transform."""
    x, y = a - a.mean(0), b - b.mean(0)
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    u, s, vt = np.linalg.svd(x.T @ y)
    fitted = y @ (u @ vt).T * s.sum()
    return float(((x - fitted) ** 2).sum()), np.linalg.norm(x - fitted, axis=1)


def mantel(a: np.ndarray, b: np.ndarray, permutations: int = 999, seed: int = 42) -> tuple[float, float]:
    """(Pearson correlation of the distances, two-sided permutation p-value)."""
    dist = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    at = np.triu_indices(len(a), 1)
    x, d = dist(a)[at], dist(b)
    r = float(np.corrcoef(x, d[at])[0, 1])
    rng, more = np.random.default_rng(seed), 0
    for _ in range(permutations):
        o = rng.permutation(len(b))
        more += abs(np.corrcoef(x, d[np.ix_(o, o)][at])[0, 1]) >= abs(r) - 1e-12
    return r, (more + 1) / (permutations + 1)
