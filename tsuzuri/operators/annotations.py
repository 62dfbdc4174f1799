"""Human annotations: sheets exported as CSV become texts with spans of connectives and sentence-final expressions.

Fill-down, counters and offsets are windows over one sheet; only Unicode normalisation and the patterns that annotators wrote
into cells need Python, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tsuzuri.operators.extract import extract_matches
from tsuzuri.operators.lexicon import CONNECTIVE, Entry

# Columns of a sheet, the heading of its title, and signs that annotators put around expressions.
COLUMNS = ("section_name", "rid", "dm", "sentence", "segments", "segment", "connective", "modality", "connective_meidai_check", "modality_meidai_check")
TITLE = "タイトル"
NOISE = "[／（）。．？]"
SENTENCE_ID = r"^[SＳ]0*(\d{1,3})"
HALF_WIDTH = "".join(chr(c) for c in range(0x20, 0x7F) if not chr(c).isdigit())
FULL_WIDTH = "".join("　" if c == " " else chr(ord(c) + 0xFEE0) for c in HALF_WIDTH)
SPAN = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(text: Column) -> Column:
    """Without blanks, NFKC (so patterns keep few special signs), full-width letters and signs but plain digits, no ideographic space at the end."""
    return F.regexp_replace(F.translate(_nfkc(F.replace(text, F.lit(" "), F.lit(""))), HALF_WIDTH, FULL_WIDTH), "　+$", "")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """sheet, line and the normalised ``COLUMNS`` of CSV sheets with a header; columns that a sheet lacks are null.

    Each file is read whole, as its rows count from its top. A path that is not there gives no rows.
    """
    schema = f"sheet string, line int, {', '.join(f'{c} string' for c in COLUMNS)}"

    def rows(batches):
        import csv
        import io

        for b in batches:
            out = []
            for name, body in zip(b["path"], b["content"]):
                for i, r in enumerate(csv.DictReader(io.StringIO(bytes(body).decode("utf-8-sig")))):
                    out.append([name, i, *(r.get(c) for c in COLUMNS)])
            yield pd.DataFrame(out, columns=["sheet", "line", *COLUMNS])

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)
    return raw.select("sheet", "line", *[normalized(F.col(c)).alias(c) for c in COLUMNS])


def placed(text: Column, pattern: Column, last: bool = False) -> Column:
    """struct(start, stop) of the first (or last) hit of an annotator's pattern; null for empty or broken patterns and without a hit."""

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series, patterns: pd.Series) -> pd.DataFrame:
        import re

        out = []
        for t, p in zip(texts, patterns):
            try:
                hits = [m.span() for m in re.finditer(p, t)] if p and t else []
            except re.error:
                hits = []
            out.append(hits[-1 if last else 0] if hits else (None, None))
        return pd.DataFrame({"start": pd.array([a for a, _ in out], "Int32"), "stop": pd.array([b for _, b in out], "Int32")})

    hit = find(text, F.regexp_replace(F.regexp_replace(pattern, NOISE, ""), "[，、]$", ""))
    return F.when(hit["start"].isNotNull(), hit)


def annotated(sheets: DataFrame) -> DataFrame:
    """sheet, line, section, title, sentence, segment, text, offset, conn, final: one row for each annotated piece of text.

    Section, title and sentence number hold until others come. Segments count from 1 in each sentence, and from 0 before the
    first one. ``offset`` is where the text stands in the joined texts of its sheet; spans count from there.
    """
    upto = Window.partitionBy("sheet").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("sheet").orderBy("line")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    df = sheets.withColumn("section", F.coalesce(F.last(full("section_name"), ignorenulls=True).over(upto), F.lit("")))
    named = (F.col("section") == TITLE) | F.coalesce(F.col("segments") == TITLE, F.lit(False))
    df = df.withColumn("title", F.coalesce(F.first(F.when(named, full("sentence")), ignorenulls=True).over(upto), F.lit("")))
    df = df.withColumn("sentence_no", F.last(F.regexp_extract("rid", SENTENCE_ID, 1).try_cast("int"), ignorenulls=True).over(upto))
    new = (~F.col("sentence_no").eqNullSafe(F.lag("sentence_no").over(order))).cast("int")
    df = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(upto))
    place = F.row_number().over(Window.partitionBy("sheet", "__run").orderBy("line"))
    df = df.withColumn("segment_no", place - F.when(F.col("sentence_no").isNull(), 1).otherwise(0))
    df = df.withColumn("text", F.regexp_replace(F.coalesce(full("segment"), full("sentence")), r"(?U)\s+$", "")).where("text is not null")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("offset", F.coalesce(before, F.lit(0)))
    shifted = lambda s: F.when(s.isNotNull(), F.struct((s["start"] + F.col("offset")).alias("start"), (s["stop"] + F.col("offset")).alias("stop")))
    df = df.withColumn("__c", placed(F.col("text"), F.col("connective"))).withColumn("__f", placed(F.col("text"), F.col("modality")))
    return df.select("sheet", "line", "section", "title", F.col("sentence_no").alias("sentence"), F.col("segment_no").alias("segment"), "text", "offset", shifted(F.col("__c")).alias("conn"), shifted(F.col("__f")).alias("final"))


def spans(rows: DataFrame, lexicon: tuple[Entry, ...] = ()) -> DataFrame:
    """sheet, key, label, start, stop over each sheet's joined text, from ``annotated``.

    Keys: c and sf (annotators' spans), segment, section_name (neighbours of one name are one span), and with a lexicon
    c_auto and m_auto, the markers that it finds.
    """
    own = lambda key, label, start, stop: F.struct(F.lit(key).alias("key"), label.cast("string").alias("label"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    end = F.col("offset") + F.length("text")
    segment = F.concat_ws("_segment_", F.coalesce(F.col("sentence").cast("string"), F.lit("None")), F.col("segment").cast("string"))
    each = F.array(
        F.when(F.col("conn").isNotNull(), own("c", F.lit("c"), F.col("conn.start"), F.col("conn.stop"))),
        F.when(F.col("final").isNotNull(), own("sf", F.lit("sf"), F.col("final.start"), F.col("final.stop"))),
        own("segment", segment, F.col("offset"), end),
    )
    out = rows.select("sheet", F.explode(F.filter(each, lambda s: s.isNotNull())).alias("s")).select("sheet", "s.*")
    order = Window.partitionBy("sheet").orderBy("line")
    named = rows.where("section <> ''").withColumn("__new", (~F.lag("section").over(order).eqNullSafe(F.col("section"))).cast("int")).withColumn("__run", F.sum("__new").over(order))
    runs = named.groupBy("sheet", "__run", "section").agg(F.min("offset").alias("start"), F.max(end).alias("stop"))
    out = out.unionByName(runs.select("sheet", F.lit("section_name").alias("key"), F.col("section").alias("label"), "start", "stop"))
    if lexicon:
        found = extract_matches(rows.select("sheet", "offset", "text"), lexicon, text="text", cross_check=False)
        key = F.when(F.col("type") == CONNECTIVE, "c_auto").otherwise("m_auto")
        auto = found.select("sheet", key.alias("key"), F.col("expr").alias("label"), (F.col("offset") + F.col("position")).cast("long").alias("start"), (F.col("offset") + F.col("end_position")).cast("long").alias("stop"))
        out = out.unionByName(auto)
    return out
