"""Small steps between matches and reports: projections, counts for titles, cuts, and rows as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsuzuri.operators.lexicon import CONNECTIVE, FINAL
from tsuzuri.operators.stats import pairs, side_by_side

# The columns that an aggregated table keeps, and the modes of grouping.
KEPT = ("sentence_id", "basename", "section", "type", "position")
GROUPS = {"none": (), "section": ("section",), "genre": ("genre1",), "both": ("section", "genre1")}


def include_sections(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return df.where(F.col("section").isin(*allowed))


def group_columns(mode: str) -> tuple[str, ...]:
    if mode not in GROUPS:
        raise ValueError(f"unknown grouping {mode}")
    return GROUPS[mode]


def selected_genre(df: DataFrame, column: str | None = None, name: str = "selected_genre") -> DataFrame:
    """The chosen genre column, or ``genre1``, or null, as ``name``."""
    for c in (column, "genre1"):
        if c and c in df.columns:
            return df.withColumn(name, F.col(c))
    return df.withColumn(name, F.lit(None).cast("string"))


def aggregated(df: DataFrame, column: str) -> DataFrame:
    """``column`` as the expression, the fixed columns, and the genres there are."""
    genres = [c for c in df.columns if c.startswith("genre")]
    return df.select(F.col(column).alias("expr"), *[c for c in KEPT if c in df.columns], *genres)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def title_counts(matches: DataFrame) -> DataFrame:
    """One row: sentences, sections, types of connectives and finals, and types of their pairs."""
    own = matches.agg(
        F.countDistinct("sentence_id").alias("sentences"),
        F.countDistinct("section").alias("sections"),
        F.countDistinct(F.when(F.col("type") == CONNECTIVE, F.col("expr"))).alias("connectives"),
        F.countDistinct(F.when(F.col("type") == FINAL, F.col("expr"))).alias("finals"),
    )
    both = pairs(matches).agg(F.countDistinct("conn", "final").alias("collocations"))
    return own.crossJoin(F.broadcast(both))  # one row each


def collocation_column(matches: DataFrame) -> DataFrame:
    """A row for each connective and final of a sentence, ``CE→SFE`` as the expression; not deduplicated."""
    both = side_by_side(matches, [F.col("section"), F.col("expr").alias("conn")], [F.col("expr").alias("final")])
    return both.select("sentence_id", "section", F.concat_ws("→", "conn", "final").alias("expr"))


def common_rows(tables: Sequence[DataFrame], key: str = "name") -> list[DataFrame]:
    """Each table's rows whose key is in all tables, as a comparison of coordinates needs."""
    keys = tables[0].select(key)
    for t in tables[1:]:
        keys = keys.join(t.select(key), key, "left_semi")
    return [t.join(keys, key, "left_semi") for t in tables]


def indexed(df: DataFrame, by: str, order: Sequence[str], name: str = "global_index") -> DataFrame:
    """A gapless index from 0 in the order of ``by`` and then ``order``.

    Rows are numbered within each value of ``by``; the sizes of the groups before it are added, so only one
    row for each group meets in one place.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(by).alias("__k"), "__b")
    own = df.withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return own.join(before, F.col(by).eqNullSafe(F.col("__k"))).withColumn(name, (F.col("__i") + F.col("__b")).cast("long")).drop("__i", "__k", "__b")


def by_pmi(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("pmi"), "conn", "final")


def shown(df: DataFrame, most: int) -> DataFrame:
    """The rows that a display shows; none for 0 or less."""
    return df.limit(max(0, most))


def hits_and_misses(wanted: DataFrame, hits: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Rows of ``hits``, and a row with nulls for each wanted key without one."""
    misses = wanted.select(key).distinct().join(hits.select(key), key, "left_anti")
    return hits.unionByName(misses, allowMissingColumns=True)


def term(definition: Column) -> Column:
    """The text in full-width brackets, else what stands before the first comma."""
    inside = F.regexp_extract(definition, "（([^）]*)）", 1)
    return F.when(inside != "", inside).otherwise(F.element_at(F.split(definition, "、"), 1))


def long_form(wide: DataFrame, key: str, name: str = "expr", value: str = "n") -> DataFrame:
    return wide.unpivot([key], [c for c in wide.columns if c != key], name, value)


def to_json(df: DataFrame, name: str = "payload") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_json(df: DataFrame, schema: str, name: str = "payload") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("x")).select("x.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_matches_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def valid_year(year: Column) -> Column:
    """A year as int; a negative one raises."""
    return F.when(year >= 0, year.cast("int")).when(year < 0, F.raise_error(F.concat(F.lit("not a year: "), year.cast("string"))).cast("int"))


def first_genre(genre: Column) -> Column:
    return F.get(genre, F.lit(0))


def map_tokens(tokens: Column, change) -> Column:
    return F.transform(tokens, change)


def filter_tokens(tokens: Column, keep) -> Column:
    return F.filter(tokens, keep)
