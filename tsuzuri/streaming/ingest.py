"""Streaming: new documents to markers, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tsuzuri.operators import extract, segment


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_matches(documents: DataFrame) -> DataFrame:
    """Stateless: repeated lines of a document stay, as only a batch can tell the first."""
    return extract.extract_matches(segment.all_sentences(segment.sections(documents)))


def running_counts(matches: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Counts by type and expression, kept up to date in the memory table ``target``."""
    counts = matches.groupBy("type", "expr").agg(F.count("*").alias("freq"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by window and type; rows later than the watermark are dropped when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
