from pyspark.sql import functions as F

from tsuzuri.operators import sections

THESIS = """# 文章の研究

## 副題

前書きの本文である。

## 3. 研究の仮説と目的

### 3.2. 本研究における仮説

仮説 1: これはテストです。

### 3.3. 研究の目的

目的はテストである。

## 6. 考察

本文。

### 細かい話

続きの本文。

### 6.3. 今後の研究課題

将来の課題について。

##### 参考文献

文献の一覧である。
"""


def _nodes(spark, *texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "basename string, text string")
    return {(int(r.basename), r.heading): r for r in sections.nodes(docs).collect()}


def test_labels_levels_and_bodies(spark):
    got = _nodes(spark, THESIS)
    assert got[0, "文章の研究"].category == "title" and got[0, "副題"].category == "subtitle"
    assert got[0, None].body == "前書きの本文である。" and not got[0, None].shown
    three, six = got[0, "3. 研究の仮説と目的"], got[0, "6. 考察"]
    assert {"hypotheses", "introduction"} <= set(three.labels) and three.number == "3."
    assert {"discussion", "future_work"} <= set(six.labels) and six.category == "discussion"
    assert six.body == "本文。\n\n続きの本文。" and not got[0, "細かい話"].shown
    assert got[0, "6.3. 今後の研究課題"].path == ["6. 考察", "6.3. 今後の研究課題"]
    assert got[0, "3.3. 研究の目的"].parent == three.idx and got[0, "3.3. 研究の目的"].category is None
    refs = got[0, "参考文献"]
    assert (refs.level, refs.parent, refs.shown) == (2, None, False)
    assert six.stop == refs.start and not got[0, "6.3. 今後の研究課題"].body.endswith("一覧である。")


def test_offsets_point_at_headings(spark):
    blocks = [b.lstrip("#").strip() for b in THESIS.strip().split("\n\n")]
    whole = "\n\n".join(blocks)
    for (_, heading), r in _nodes(spark, THESIS).items():
        if heading:
            assert whole[r.start : r.start + len(heading)] == heading and r.start < r.stop <= len(whole)


def test_plain_headings_and_untidy_texts(spark):
    got = _nodes(spark, "# 題\n\nこれは本文です。\n\n注\n\n- (1) 注記の内容です。\n", "", None, "図1 結果\n\n本文である。", "注\n\n注\n\n注")
    assert got[0, "注"].category == "notes" and got[0, "注"].body == "- (1) 注記の内容です。"
    assert not [k for k in got if k[0] in (1, 2)]
    assert [k for k in got if k[0] == 3] == [(3, None)]
    assert got[4, "注"].category == "notes"


def test_text_behind_a_skipped_section_goes(spark):
    text = "## 考察\n\n本文。\n\n### キーワード\n\n語。\n\n### 別の話\n\n消える。\n\n#### もっと\n\n消える。\n\n## 結論\n\n終わる。"
    got = _nodes(spark, text)
    assert got[0, "考察"].body == "本文。" and got[0, "結論"].body == "終わる。"
    assert {h for (_, h), r in got.items() if r.shown} == {"考察", "結論"}


def test_numbered_headings_become_sections_of_one_level(spark):
    text = "\n\n".join(f"{'#' * n} {h}\n\n本文である。" for n, h in ((2, "1. はじめに"), (4, "2. 方法"), (3, "3. 結果"), (5, "3.1 細部")))
    got = _nodes(spark, text)
    assert [got[0, h].level for h in ("1. はじめに", "2. 方法", "3. 結果", "3.1 細部")] == [2, 2, 2, 3]
    assert got[0, "3.1 細部"].parent == got[0, "3. 結果"].idx


def test_section_texts_leave_out_what_is_skipped(spark):
    docs = spark.createDataFrame([("a", THESIS)], "basename string, text string")
    got = {r.section for r in sections.section_texts(docs).collect()}
    assert "references" not in got and {"discussion", "introduction", "future_work"} <= got


def test_repaired_prefix(spark):
    rows = spark.createDataFrame([("lV.",), ("1O.",), ("2.",), ("第3章",)], "p string")
    assert [r.x for r in rows.select(sections.repaired_prefix(F.col("p")).alias("x")).collect()] == ["IV.", "10.", "2.", "第3章"]
