from tsuzuri.sources import corpus
from tsuzuri.streaming import ingest


def test_folder_front_matter_and_tables(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ncorpus: C\nkeywords: [k1, k2]\nyear: 2001\n---\n# はじめに\n本文。\n\n- 項目\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("no front matter", encoding="utf-8")
    docs = corpus.documents(spark, str(tmp_path))
    got = {r.basename: r for r in corpus.genre_meta(corpus.front_matter(docs)).collect()}
    assert got["a"].genre_path == "C / k1" and got["a"].year == 2001 and got["a"].text.startswith("# はじめに") and got["b"].meta is None
    assert docs.agg(corpus.has_front_matter_majority()).first()[0]
    kinds = [(r.kind, r.level, r.body) for r in corpus.markdown_blocks(corpus.front_matter(docs)).where("basename = 'a'").orderBy("idx").collect()]
    assert kinds == [("header", 1, "はじめに"), ("para", 0, "本文。"), ("item", 0, "- 項目")]
    (tmp_path / "s.tsv").write_text("ファイル名\tタイトル\t著者\na\tT\tX\nz\tU\tY\n\tV\tZ\n", encoding="utf-8")
    src = corpus.source_table(spark, str(tmp_path / "s.tsv"))
    assert {(r.basename, r.exists, r.year) for r in corpus.listing(docs, src, "g").collect()} == {("a", True, "2010"), ("z", False, "2010")}


def test_jsonl_and_runs(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"title":"t","genre":["g"],"sentences":["a","b"]}\n{"title":"u","genre":["h"],"text":"c"}\n')
    assert [r.sentence for r in corpus.jsonl(spark, str(tmp_path / "c.jsonl")).orderBy("title", "pos").collect()] == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, "t", "g", "a"), (2, "t", "h", "b"), (3, "u", "g", "c"), (4, "t", "g", "d")], "line long, title string, genre string, sentence string")
    got = sorted((r.run, r.title, r.genre, r.sentences) for r in corpus.grouped_records(rows).collect())
    assert got == [(1, "t", "h", ["a", "b"]), (2, "u", "g", ["c"]), (3, "t", "g", ["d"])]
    corpus.write_csv(rows, str(tmp_path / "out"), by="title")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4
    assert corpus.sampled(rows, 0.5, "line").count() == 2


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the cat is walking\nand so", "en", "s", 25)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "docs"))
    q = ingest.running_counts(ingest.stream_matches(ingest.stream_documents(spark, str(tmp_path / "docs"))), "counts_now", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r.expr, r.freq) for r in spark.table("counts_now").collect()} == {("the", 1), ("ing", 1), ("and", 1)}


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
