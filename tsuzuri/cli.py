"""Command line: extract markers from a corpus, count them, report collocations.

    python -m tsuzuri.cli extract CORPUS OUT      folder of Markdown or text, JSONL file, or Parquet sections
    python -m tsuzuri.cli count MATCHES OUT
    python -m tsuzuri.cli surfaces MATCHES OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsuzuri.operators import extract, lexicon, search, sections, segment, stats
from tsuzuri.sources import corpus


def sections_of(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """basename, section, genre1, text of any supported source; Markdown is split into labelled sections, other text has no section."""
    if path.endswith((".jsonl", ".json")):
        rows = corpus.jsonl(spark, path)
        return rows.groupBy("title", "genre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), "\n").alias("text")).select(F.col("title").alias("basename"), F.lit(None).cast("string").alias("section"), F.get("genre", F.lit(0)).alias("genre1"), "text")
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    docs = corpus.genre_meta(corpus.front_matter(corpus.documents(spark, path, ext)))
    marked = sections.section_texts(docs.where("ext = 'md'")).select("basename", "section", "text").join(docs.select("basename", "genre1"), "basename")
    plain = docs.where("ext <> 'md'").select("basename", "genre1", F.lit(None).cast("string").alias("section"), "text")
    return marked.unionByName(plain)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tsuzuri")
    p.add_argument("task", choices=("extract", "count", "surfaces"))
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--ext")
    p.add_argument("--sample", type=float, help="share of the documents, drawn by hash")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tsuzuri").getOrCreate()
    if a.task == "extract":
        texts = sections_of(spark, a.source, a.ext)
        if a.sample:
            texts = corpus.sampled(texts, a.sample)
        found = extract.extract_matches(segment.sentences(texts), lexicon.connectives())
        found.drop("para", "line", "paragraph_text").write.mode("overwrite").parquet(a.out)
        return
    matches = spark.read.parquet(a.source)
    if a.task == "count":
        corpus.write_csv(stats.count_by(matches), a.out)
    else:
        corpus.write_csv(search.collocation_report(matches), a.out, by="final")


if __name__ == "__main__":
    main()
