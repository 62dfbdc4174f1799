from pyspark.sql import functions as F

from tsuzuri.operators import annotations, lexicon

HEAD = "section_name,rid,dm,sentence,segments,segment,connective,modality\n"
SHEET = HEAD + """タイトル,,,文章の研究,,,,
はじめに,S001,,,,だから、明らかで,だから、,
,S001,,,,あると思われる。,,思われる。
,S002,,,,また（よい）。,［,
結論,S003,,また、終わる。,,,また,終わる
"""


def _sheets(spark, tmp_path, text=SHEET):
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    return annotations.read_sheets(spark, str(tmp_path / "a.csv"))


def test_normalized(spark):
    rows = spark.createDataFrame([("Ａb c１2(ｱ)　",), ("",), (None,)], "t string")
    assert [r.x for r in rows.select(annotations.normalized(F.col("t")).alias("x")).collect()] == ["Ａｂｃ12（ア）", "", None]


def test_rows_count_and_fill_down(spark, tmp_path):
    got = annotations.annotated(_sheets(spark, tmp_path)).orderBy("line").collect()
    assert [(r.section, r.sentence, r.segment) for r in got] == [("タイトル", None, 0), ("はじめに", 1, 1), ("はじめに", 1, 2), ("はじめに", 2, 1), ("結論", 3, 1)]
    assert {r.title for r in got} == {"文章の研究"}
    joined = "".join(r.text for r in got)
    assert all(joined[r.offset : r.offset + len(r.text)] == r.text for r in got)
    cut = lambda s: joined[s.start : s.stop] if s else None
    assert [cut(r.conn) for r in got] == [None, "だから", None, None, "また"]
    assert [cut(r.final) for r in got] == [None, None, "思われる", None, "終わる"]


def test_spans_of_sections_merge(spark, tmp_path):
    rows = annotations.annotated(_sheets(spark, tmp_path))
    joined = "".join(r.text for r in rows.orderBy("line").collect())
    got = annotations.spans(rows, tuple(lexicon.connectives())).orderBy("start").collect()
    assert [(r.label, joined[r.start : r.stop]) for r in got if r.key == "section_name"] == [("タイトル", "文章の研究"), ("はじめに", "だから、明らかであると思われる。また（よい）。"), ("結論", "また、終わる。")]
    assert [r.label for r in got if r.key == "segment"] == ["None_segment_0", "1_segment_1", "1_segment_2", "2_segment_1", "3_segment_1"]
    assert [joined[r.start : r.stop] for r in got if r.key == "c_auto"] == ["だから", "また"]


def test_no_sheet_and_empty_sheet(spark, tmp_path):
    assert annotations.read_sheets(spark, str(tmp_path / "none.csv")).count() == 0
    assert annotations.annotated(_sheets(spark, tmp_path, HEAD)).count() == 0
