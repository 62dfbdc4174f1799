"""Collocation search, sampling and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsuzuri.operators.lexicon import CONNECTIVE, FINAL
from tsuzuri.operators.stats import side_by_side

ANY, NONE = "(any)", "(None)"


def filter_by(df: DataFrame, expr: str | None = None, types: Sequence[str] | None = None, genres: Sequence[str] | None = None, genre: str = "genre1") -> DataFrame:
    if expr:
        df = df.where(F.col("span_text").rlike(expr))
    if types:
        df = df.where(F.col("type").isin(*types))
    if genres:
        df = df.where(F.col(genre).isin(*genres))
    return df


def exclude_sections(df: DataFrame, excluded: Sequence[str], keep_null: bool = False) -> DataFrame:
    """SQL's three-valued logic drops rows without a section; ``keep_null`` keeps them."""
    ok = ~F.col("section").isin(*excluded)
    return df.where(F.col("section").isNull() | ok if keep_null else ok)


def having(sentences: DataFrame, matches: DataFrame, kind: str, value: str | None) -> DataFrame:
    """Sentences with a marker of a type and expression (any of the type for ``ANY``), or with none of the type for ``NONE``."""
    if value is None:
        return sentences
    mine = matches.where(F.col("type") == kind)
    if value == NONE:
        return sentences.join(mine.select("sentence_id"), "sentence_id", "left_anti")
    if value != ANY:
        mine = mine.where(F.col("expr") == value)
    return sentences.join(mine.select("sentence_id"), "sentence_id", "left_semi")


def search(sentences: DataFrame, matches: DataFrame, query: str | None = None, case_sensitive: bool = False, conn: str | None = None, final: str | None = None, require_both: bool = False) -> DataFrame:
    """Distinct hits (basename, section, sentence_text, sentence_id)."""
    s = sentences
    if query:
        s = s.where(F.col("sentence_text").rlike(query) if case_sensitive else F.lower("sentence_text").rlike(query.lower()))
    s = having(having(s, matches, CONNECTIVE, conn), matches, FINAL, final)
    if require_both:
        both = matches.groupBy("sentence_id").agg(F.countDistinct("type").alias("types")).where("types >= 2")
        s = s.join(both.select("sentence_id"), "sentence_id", "left_semi")
    return s.groupBy("basename", "section", "sentence_text").agg(F.min("sentence_id").alias("sentence_id"))


def per_million(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits")).crossJoin(F.broadcast(sentences.agg(F.countDistinct("sentence_id").alias("sentences")))).withColumn("ppm", F.col("hits") / F.col("sentences") * 1e6)  # one row each


def _drawn(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def sample_by_section(df: DataFrame, most: int, section: str = "section", key: str = "basename", balance: str | None = None, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each section; with ``balance``, an equal share for each of its values, the rest to values drawn by hash."""
    if most <= 0:
        return df.limit(0)
    drawn = _drawn(key, seed)
    if not balance:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(section).orderBy(drawn, key))).where(F.col("rn") <= most).drop("rn")
    # The values of a section are counted first, so that no window needs all rows of a section.
    groups = df.select(section, balance).distinct()
    order = F.md5(F.concat(F.coalesce(F.col(balance).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    shares = groups.withColumn("g", F.count(F.lit(1)).over(Window.partitionBy(section))).withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(order)))
    shares = shares.select(F.col(section).alias("__s"), F.col(balance).alias("__b"), (F.floor(F.lit(most) / F.col("g")) + F.when(F.col("place") <= F.lit(most) % F.col("g"), 1).otherwise(0)).alias("share"))
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(section, balance).orderBy(drawn, key)))
    return rows.where(F.col("rn") <= most).join(shares, F.col(section).eqNullSafe(F.col("__s")) & F.col(balance).eqNullSafe(F.col("__b"))).where(F.col("rn") <= F.col("share")).drop("rn", "share", "__s", "__b")


def pair_samples(pairs: DataFrame, sentences: DataFrame, most: int = 5, seed: int = 42) -> DataFrame:
    """Up to ``most`` sentences of each pair, drawn by hash of the sentence id."""
    by = Window.partitionBy("final", "conn").orderBy(_drawn("sentence_id", seed), "sentence_id")
    few = pairs.select("final", "conn", "sentence_id").distinct().withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)
    text = sentences.select("sentence_id", "sentence_text").dropDuplicates(["sentence_id"])
    return few.join(text, "sentence_id", "left")


def surface_forms(matches: DataFrame, side: str = FINAL) -> DataFrame:
    """final, conn, surface text of ``side`` and its frequency, over all pairs of a sentence (no deduplication)."""
    conn, final, surface = F.col("expr").alias("conn"), F.col("expr").alias("final"), F.col("span_text").alias("surface")
    both = side_by_side(matches, [conn], [final, surface]) if side == FINAL else side_by_side(matches, [conn, surface], [final])
    return both.groupBy("final", "conn", "surface").agg(F.count("*").alias("n"))


def listed(forms: DataFrame, top: int = 10) -> DataFrame:
    """final, conn, freq, types and the ``top`` forms as ``form: n``, the rest as ``他(types): n``."""
    by = Window.partitionBy("final", "conn").orderBy(F.desc("n"), "surface")
    f = forms.withColumn("rn", F.row_number().over(by))
    inside = F.col("rn") <= top
    g = f.groupBy("final", "conn").agg(
        F.sum("n").alias("freq"), F.count("*").alias("types"),
        F.sum(F.when(~inside, F.col("n"))).alias("rest"), F.count_if(~inside).alias("more"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("rn", "surface", "n")))).alias("top"),
    )
    shown = F.array_join(F.transform("top", lambda x: F.concat(x["surface"], F.lit(": "), x["n"].cast("string"))), "; ")
    rest = F.when(F.col("more") > 0, F.concat(F.lit("; 他("), F.col("more").cast("string"), F.lit("): "), F.col("rest").cast("string"))).otherwise("")
    return g.select("final", "conn", "freq", "types", F.concat(shown, rest).alias("forms"))


def collocation_report(matches: DataFrame) -> DataFrame:
    sf = listed(surface_forms(matches, FINAL)).select("final", "conn", "freq", F.col("forms").alias("final_forms"))
    ce = listed(surface_forms(matches, CONNECTIVE)).select("final", "conn", F.col("forms").alias("conn_forms"))
    return sf.join(ce, ["final", "conn"])


def quality_report(matches: DataFrame) -> DataFrame:
    """Counts of what must not occur: missing genre, several connectives in a sentence, repeated anchors."""
    null = matches.agg(F.count_if(F.col("genre1").isNull()).alias("null_genre"))
    multi = matches.where(F.col("type") == CONNECTIVE).groupBy("sentence_id").agg(F.countDistinct("expr").alias("k")).where("k > 1").agg(F.count("*").alias("multi_connective"))
    twice = matches.groupBy("sentence_id", "type", "expr", "position", "end_position").count().where("count > 1").agg(F.count("*").alias("anchor_dups"))
    return null.crossJoin(F.broadcast(multi)).crossJoin(F.broadcast(twice))  # one row each
