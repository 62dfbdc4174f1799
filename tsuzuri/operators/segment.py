"""From documents to sections, paragraphs, sentences and fixed-width segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsuzuri.functions.text import row_key

LINE = r"\R"
# Section labels left out by default.
EXCLUDED = ("references", "acknowledgments", "notes", "abstract", "keywords", "toc", "appendix", "author_bio", "author", "title", "subtitle", "unknown")


def sections(documents: DataFrame) -> DataFrame:
    """The driver's documents as sections: basename, section, genre1, text, text_len."""
    return documents.select(F.col("doc_id").alias("basename"), F.col("lang").alias("section"), F.col("source").alias("genre1"), "text", F.length("text").alias("text_len"))


def all_sentences(sections: DataFrame, keep: tuple[str, ...] = ("basename", "section", "genre1")) -> DataFrame:
    """One row for each non-blank line of each paragraph, repeats included."""
    paras = sections.select(*keep, F.posexplode(F.split("text", "\n\n")).alias("para", "paragraph_text"))
    lines = paras.select(*keep, "para", "paragraph_text", F.posexplode(F.split("paragraph_text", LINE)).alias("line", "sentence_text"))
    lines = lines.where(F.col("sentence_text").rlike(r"\S"))
    return lines.withColumn("sentence_id", row_key(F.col("basename"), F.col("section"), F.col("sentence_text")))


def sentences(sections: DataFrame, keep: tuple[str, ...] = ("basename", "section", "genre1")) -> DataFrame:
    """``all_sentences`` with the first row of each sentence id."""
    first = Window.partitionBy("sentence_id").orderBy("basename", "para", "line")
    return all_sentences(sections, keep).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Blank-line separated paragraphs; a line of white space is blank."""
    parts = F.split(F.regexp_replace(text, r"(?m)^[ \t]+$", ""), "\n{2,}")
    return df.select("*", F.posexplode(parts).alias("para", "paragraph_text")).where(F.col("paragraph_text").rlike(r"\S"))


def segments(sections: DataFrame, width: int = 60, preview: int = 50) -> DataFrame:
    """Fixed-width character windows; an empty text has one empty segment."""
    n = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / width)).cast("int")
    rows = sections.withColumn("segment_index", F.explode(F.sequence(F.lit(0), n - 1)))
    body = F.substring(F.coalesce("text", F.lit("")), F.col("segment_index") * width + 1, F.lit(width))
    start = F.col("segment_index") * width
    rows = rows.withColumn("start_char", start).withColumn("end_char", F.least(start + width, F.length(F.coalesce("text", F.lit("")))))
    return rows.withColumn("preview", F.when(F.length(body) > preview, F.concat(F.substring(body, 1, preview), F.lit("..."))).otherwise(body)).drop("text")


def wrap(df: DataFrame, index: str, columns: int) -> DataFrame:
    w = max(1, columns)
    return df.withColumn("col", (F.col(index) % w).cast("long")).withColumn("row", F.floor(F.col(index) / w).cast("long"))


def split_long(text: Column, most: int = 500) -> Column:
    """Greedy packing of full-stop sentences into chunks of at most ``most`` bytes; a longer sentence stays alone."""
    parts = F.filter(F.split(text, "(?<=[。．！？\n])"), lambda x: x != "")
    start = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.octet_length(last) + F.octet_length(x) <= most)
        return F.when(fits, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last, x))).otherwise(F.array_append(acc, x))

    return F.aggregate(parts, start, step)
