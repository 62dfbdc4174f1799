"""Marker networks: consecutive markers of a sentence as edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_events(df: DataFrame, by: Sequence[str], order: Sequence[str], expr: str) -> DataFrame:
    """src, dst of each pair of neighbours within a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(*by, *order, F.col(expr).alias("src"), F.lead(expr).over(w).alias("dst")).where("dst is not null")


def edges(events: DataFrame) -> DataFrame:
    """src, dst, weight, pmi with all totals at the end (order-free)."""
    w = events.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    deg = w.select(F.col("src").alias("node"), "weight").unionAll(w.select("dst", "weight")).groupBy("node").agg(F.sum("weight").alias("deg"))
    total = w.agg(F.sum("weight").alias("total"))
    out = w.join(deg.select(F.col("node").alias("src"), F.col("deg").alias("sdeg")), "src").join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("ddeg")), "dst").crossJoin(F.broadcast(total))  # total: one row
    t = F.col("total")
    return out.select("src", "dst", "weight", F.log2((F.col("weight") / t) / ((F.col("sdeg") / t) * (F.col("ddeg") / t))).alias("pmi"))


def nodes(records: DataFrame, events: DataFrame, expr: str) -> DataFrame:
    """node, frequency (records and edge ends), entropy over successors divided by all ends."""
    w = events.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    ends = w.select(F.col("src").alias("node"), "weight").unionAll(w.select("dst", "weight")).groupBy("node").agg(F.sum("weight").alias("deg"))
    p = F.col("weight") / F.col("deg")
    ent = w.withColumnRenamed("src", "node").join(ends, "node").groupBy("node").agg(F.sum(-p * F.log2(p)).alias("entropy"))
    own = records.groupBy(F.col(expr).alias("node")).agg(F.count("*").alias("n"))
    return own.join(ends, "node", "left").join(ent, "node", "left").select("node", (F.col("n") + F.coalesce("deg", F.lit(0))).alias("frequency"), (F.coalesce("entropy", F.lit(0.0)) + 0.0).alias("entropy"))


def running_edges(events: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Edges whose PMI is the one at their last event, with running totals at that moment; needs a global order of events.

    A rank per event is unavoidable here, as the totals depend on all events before; use ``edges`` for large data.
    """
    t = events.withColumn("t", F.row_number().over(Window.orderBy(*order)))
    ends = t.select("t", F.col("src").alias("node")).unionAll(t.select("t", "dst"))
    grouped = ends.groupBy("node", "t").agg(F.count("*").alias("k"))
    w = Window.partitionBy("node").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = grouped.select("node", "t", F.sum("k").over(w).alias("deg"))
    last = t.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.max("t").alias("t"))
    out = last.join(run.select(F.col("node").alias("src"), "t", F.col("deg").alias("sdeg")), ["src", "t"]).join(run.select(F.col("node").alias("dst"), "t", F.col("deg").alias("ddeg")), ["dst", "t"])
    n = F.col("t")
    return out.select("src", "dst", "weight", F.log2((F.col("weight") / n) / ((F.col("sdeg") / n) * (F.col("ddeg") / n))).alias("pmi"))


def filtered(edge: DataFrame, node: DataFrame, min_pmi: float = 0.0, min_entropy: float = 0.0, min_freq: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges, then nodes, then nodes left without edges."""
    e = edge.where(F.col("pmi") >= min_pmi)
    n = node.where((F.col("entropy") >= min_entropy) & (F.col("frequency") >= min_freq))
    e = e.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    used = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return e.select("src", "dst", "weight", "pmi"), n.join(used, "node", "left_semi")


def pajek(edge: DataFrame) -> DataFrame:
    """Lines of a Pajek file: vertices in order of name, then arcs (column value, ordered by line).

    The file numbers its vertices, so names are ranked in one order; they are the expressions of a lexicon.
    """
    names = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct().withColumn("i", F.row_number().over(Window.orderBy("node")).cast("long"))
    row = lambda df, part, a, b, value: df.select(F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"), value.alias("value"))
    none = F.lit(0)
    head = row(names.agg(F.count("*").alias("n")), 0, none, none, F.concat(F.lit("*vertices "), F.col("n").cast("string")))
    vertices = row(names, 1, F.col("i"), none, F.format_string('%d "%s"', "i", "node"))
    middle = row(edge.sparkSession.range(1), 2, none, none, F.lit("*arcs"))
    arcs = edge.join(names.select(F.col("node").alias("src"), F.col("i").alias("x")), "src").join(names.select(F.col("node").alias("dst"), F.col("i").alias("y")), "dst")
    body = row(arcs, 3, F.col("x"), F.col("y"), F.format_string("%d %d %d", "x", "y", "weight"))
    return head.union(vertices).union(middle).union(body).orderBy("part", "a", "b").select("value")


def drawn_parts(edge: DataFrame, min_weight: int = 1, min_degree: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) for a drawing: weight and degree cuts, then the logarithm of the weights."""
    e = edge.where(F.col("weight") >= min_weight)
    ends = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_degree)
    e = e.join(ends.select(F.col("node").alias("src")), "src", "left_semi").join(ends.select(F.col("node").alias("dst")), "dst", "left_semi")
    return e.select("src", "dst", "weight", F.log10("weight").alias("log_weight")), ends
