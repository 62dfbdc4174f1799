"""Corpus sources and sinks: folders of Markdown or text, TSV metadata, front matter, JSONL, CSV, Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsuzuri.functions.text import split_keywords

# Japanese column names of metadata tables.
RENAMED = {"ファイル名": "basename", "タイトル": "journal_title", "著者": "author", "論文誌": "journal_name", "巻": "vol", "号": "no", "ページ数": "pages", "年": "year", "ジャンル": "genre"}
FIVE = ("journal_title", "author", "year", "basename", "permission")
RECORD = "title string, genre array<string>, sentences array<string>, text string"
FRONT = r"(?s)^\x{FEFF}?(?:---|\+\+\+)[ \t]*\n(.*?)\n(?:---|\+\+\+)[ \t]*(?:\n|\z)"


def documents(spark: SparkSession, folder: str, ext: str | None = None) -> DataFrame:
    """path, basename, ext, size, text for each file; without ``ext``, Markdown if there is any, else text files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    if ext is None:
        ext = "md" if not listed.where(kind == "md").isEmpty() else "txt"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext.lstrip('.')}").text(folder, wholetext=True)
    meta = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    name = F.regexp_replace(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)), r"(\.pre)?\.[A-Za-z0-9]+$", "")
    return meta.withColumn("basename", name).withColumn("ext", F.lit(ext))


def front_matter(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with meta (map of text) and the text after the front matter; no or broken front matter: null."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        at = None
        for b in batches:
            at = b.schema.get_field_index("__yaml") if at is None else at
            out = []
            for y in b.column(at).to_pylist():
                try:
                    got = yaml.safe_load(y) if y else None
                except yaml.YAMLError:
                    got = dict(x.split(":", 1) for x in y.splitlines() if ":" in x) or None
                out.append([(str(k).strip(), "、".join(map(str, v)) if isinstance(v, list) else str(v).strip()) for k, v in got.items()] if isinstance(got, dict) else None)
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.map_(pa.string(), pa.string()))], names=[*(n for i, n in enumerate(b.schema.names) if i != at), "meta"])

    body = docs.withColumn("__yaml", F.regexp_extract(text, FRONT, 1)).withColumn(text, F.regexp_replace(text, FRONT, ""))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return body.select(*docs.columns, "__yaml").mapInArrow(parse, f"{kept}, meta map<string,string>")


def has_front_matter_majority(text: str = "text") -> Column:
    """Aggregate: whether at least half of the files have front matter."""
    return F.avg(F.col(text).rlike(FRONT).cast("int")) >= 0.5


def genre_meta(docs: DataFrame) -> DataFrame:
    """corpus, subject_area, keywords, genre1..3 and genre_path from ``meta``."""
    m = lambda k: F.col("meta")[k]
    words = split_keywords(m("keywords"))
    g1, g2, g3 = F.coalesce(m("genre1"), m("corpus")), F.coalesce(m("genre2"), m("subject_area")), F.coalesce(m("genre3"), F.get(words, F.lit(0)))
    return docs.withColumns({"corpus": m("corpus"), "subject_area": m("subject_area"), "keywords": words, "genre1": g1, "genre2": g2, "genre3": g3, "genre_path": F.concat_ws(" / ", g1, g2, g3), "year": F.when(m("year").rlike(r"^\d+$"), m("year").cast("int"))})


def source_table(spark: SparkSession, path: str) -> DataFrame:
    """Metadata TSV with a header (renamed, year and permission filled in) or with the five fixed columns."""
    first = spark.read.text(path).first()
    cells = first.value.split("\t") if first else []
    headed = any(c in ("basename", "ファイル名") for c in cells) or bool(cells) and all(c.isalpha() or not c.isascii() for c in cells)
    if not headed:
        return spark.read.schema(", ".join(f"{c} string" for c in FIVE)).csv(path, sep="\t", quote="")
    df = spark.read.csv(path, sep="\t", quote="", header=True).withColumnsRenamed(RENAMED)
    for name, value in (("year", "2010"), ("permission", "1")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def folder_genre(spark: SparkSession, path: str) -> str | None:
    row = spark.read.schema("code string, genre string").csv(path, sep="\t").first()
    return row.genre if row else None


def listing(files: DataFrame, sources: DataFrame, genre: str | None = None, strict: bool = False) -> DataFrame:
    """Metadata of a folder: table rows beside files; ``exists`` tells which have one.  Blank names go; ``strict`` needs title and genre."""
    s = sources.where("basename is not null and trim(basename) not in ('', 'null')")
    f = files.select("basename", "path", "size", "ext")
    out = s.join(f, "basename", "left").withColumn("exists", F.col("path").isNotNull())
    out = out.withColumn("genre", F.coalesce(F.col("genre") if "genre" in out.columns else F.lit(None).cast("string"), F.lit(genre)))
    return out.where("journal_title is not null and genre is not null") if strict else out


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """title, genre, pos, sentence of records with ``sentences`` or ``text``."""
    rec = spark.read.schema(RECORD).json(path)
    lines = F.coalesce("sentences", F.array("text"))
    return rec.select("title", "genre", F.posexplode(lines).alias("pos", "sentence"))


def grouped_records(rows: DataFrame, order: str = "line") -> DataFrame:
    """Runs of rows with the same title as one record {title, genre, sentences}; the run's last genre wins."""
    w = Window.orderBy(order)
    new = F.when(F.lag("title").over(w).eqNullSafe(F.col("title")), 0).otherwise(1)
    runs = rows.withColumn("__n", new).withColumn("run", F.sum("__n").over(w))
    kept = F.transform(F.array_sort(F.collect_list(F.struct(order, "sentence"))), lambda x: x["sentence"])
    return runs.groupBy("run", "title").agg(F.max_by("genre", order).alias("genre"), kept.alias("sentences"))


def sampled(df: DataFrame, share: float, key: str = "basename", seed: int = 42) -> DataFrame:
    """An exact share of the rows (one at least), drawn by hash."""
    n = max(1, int(df.count() * share))
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def only(df: DataFrame, names: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    df = df.where(F.col("basename").isin(*names)) if names else df
    return df.where(~F.col("basename").isin(*without)) if without else df


def markdown_blocks(docs: DataFrame, key: str = "basename", text: str = "text") -> DataFrame:
    """key, idx, kind (header, item, quote, table, para), level, body of the blank-line separated blocks; headings stand alone."""
    spaced = F.regexp_replace(text, r"(?m)^(#{1,6}[ \t]+[^\n]*)$", "\n\n$1\n\n")
    rows = docs.select(key, F.posexplode(F.filter(F.split(spaced, r"\n[ \t]*\n+"), lambda b: b.rlike(r"\S"))).alias("idx", "body"))
    body = F.trim("body")
    head = F.length(F.regexp_extract(F.regexp_replace("body", r"^\n+", ""), r"^(#{1,6})[ \t]", 1))
    kind = F.when(head > 0, "header").when(F.regexp_replace("body", r"^\n+", "").rlike(r"^([-*+]|\d+[.)])[ \t]"), "item").when(body.rlike("^>"), "quote").when(body.rlike(r"^\|"), "table").otherwise("para")
    clean = F.regexp_replace(F.regexp_replace("body", r"^\s*#{1,6}[ \t]+", ""), r"^\s+|\s+$", "")
    return rows.select(key, "idx", kind.alias("kind"), head.alias("level"), clean.alias("body"))


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Columns in sorted order, with a header; ``by`` makes one folder for each file-safe value."""
    out = df.select(*sorted(df.columns))
    if by:
        from tsuzuri.functions.text import file_safe

        out.withColumn("part", file_safe(F.col(by))).repartition("part").write.mode("overwrite").partitionBy("part").csv(path, header=True)
    else:
        out.write.mode("overwrite").csv(path, header=True)
