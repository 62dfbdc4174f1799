import pytest
from pyspark.sql import functions as F

from tsuzuri.operators import extract, network, reports, segment, stats, structure
from tsuzuri.operators.lexicon import CONNECTIVE, FINAL, connectives


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_longest_heading_label_wins(spark):
    heads = ["方法と結果", "3. 分析結果", "はじめに", "引用文献", "研究の方法"]
    df = spark.createDataFrame([(h,) for h in heads], "h string").select("h", structure.heading_labels(F.col("h")).alias("l"))
    got = {r.h: r.l for r in df.collect()}
    assert got == {"方法と結果": ["methods"], "3. 分析結果": ["results"], "はじめに": ["introduction"], "引用文献": ["references"], "研究の方法": ["methods"]}
    assert {"author", "title", "subtitle"} <= set(segment.EXCLUDED)


def test_heading_prefixes_and_author_lines(spark):
    rows = [("（1）方法", "parenthesis", 1), ("3.1 結果", "dot", 2), ("2 結果", "plain", 1), ("IV. 考察", "roman", 0), ("二、考察", "kanji", 0), ("①はじめに", "circled", 0), ("結論", "none", 0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "h string")
    got = {r.h: (r.s, r.n) for r in df.select("h", structure.heading_prefix_style(F.col("h")).alias("s"), structure.numeric_components(F.col("h")).alias("n")).collect()}
    assert got == {h: (s, n) for h, s, n in rows}
    lines = spark.createDataFrame([("東京大学大学院",), ("山田太郎（京都市）",), ("これは本文である。",)], "t string")
    assert [r.x for r in lines.select(structure.author_like(F.col("t")).alias("x")).collect()] == [True, True, False]


def test_pajek_of_many_nodes(spark):
    edges = spark.range(2500).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"), F.lit(0.0).alias("pmi"))
    lines = [r.value for r in network.pajek(edges).collect()]
    assert lines[0] == "*vertices 2501" and lines[1] == '1 "n00000"' and lines[2502] == "*arcs" and lines[2503] == "1 2 1" and lines[-1] == "2500 2501 1" and len(lines) == 5003


def test_highlights(spark):
    span = lambda *p: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in p])
    t = "a<b\"c'd&e"
    assert one(spark, extract.highlight(F.col("t"), span((0, 2))), t=t) == "<mark>a&lt;</mark>b&quot;c&#x27;d&amp;e"
    got = one(spark, extract.highlight_both(F.col("t"), span((0, 4)), span((2, 6))), t="abcdefgh")
    assert got == '<span class="conn">ab</span><span class="both">cd</span><span class="end">ef</span>gh'
    assert one(spark, extract.highlight_both(F.col("t"), span((0, 0)), span((1, 9))), t="x<y") == 'x<span class="end">&lt;y</span>'


def test_sweeps_and_strict_search(spark):
    spans = F.expr("array(" + ", ".join(f"named_struct('start', {a}, 'stop', {b}, 'i', 0)" for a, b in ((1, 5), (0, 2), (0, 3), (5, 6))) + ")")
    assert [(s.start, s.stop) for s in one(spark, extract.keep_first(spans))] == [(0, 3), (5, 6)]
    rows = spark.createDataFrame([(1, "だから、行く"), (2, "だから行く")], "sentence_id long, sentence_text string")
    assert [r.sentence_id for r in extract.extract_matches(rows, connectives()).collect()] == [1]
    lexicon = [extract.Entry(CONNECTIVE, "so", "1a", "新", "^(so)")]
    english = spark.createDataFrame([(1, "so, we go"), (2, "so we go")], "sentence_id long, sentence_text string")
    assert sorted(r.sentence_id for r in extract.extract_matches(english, lexicon).collect()) == [1, 2]
    assert [r.sentence_id for r in extract.extract_matches(english, lexicon, strict=True).collect()] == [1]


def test_spans_and_lines(spark):
    m = spark.createDataFrame([(1, "a", 3, 4), (1, "a", 0, 1), (1, "b", 5, 6)], "sentence_id long, expr string, position int, end_position int")
    got = extract.spans_by_label(m).first().spans
    assert [(s.position, s.end_position) for s in got["a"]] == [(0, 1), (3, 4)] and len(got["b"]) == 1
    df = spark.createDataFrame([("ab\n \ncd", p) for p in (0, 2, 3, 5, 9)], "t string, p int")
    assert [(r.x.sentence, r.x.body) for r in df.select(structure.sentence_of(F.col("t"), F.col("p")).alias("x")).collect()] == [(0, "ab"), (-1, None), (-1, None), (2, "cd"), (-1, None)]


def test_chi2_tail(spark):
    for x, dof, p in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.5, 4, 0.9735009788), (0.0, 3, 1.0), (100.0, 2, 1.9287498479e-22)):
        assert stats.chi2_upper(x, dof) == pytest.approx(p, rel=1e-8)
    table = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 20), ("b", "y", 10)], "cat string, expr string, n long")
    assert stats.chi2_p(stats.chi2_summary(table)).first().p == pytest.approx(0.00982327450752, rel=1e-6)


def test_small_steps(spark, tmp_path):
    df = spark.createDataFrame([("s", "g", 1), (None, "h", 2), ("t", None, 3)], "section string, genre1 string, n long")
    assert reports.include_sections(df, ["s"]).count() == 1 and reports.complete(df, ["section", "genre1"]).count() == 1
    assert [r.selected_genre for r in reports.selected_genre(df, "genre9").orderBy("n").collect()] == ["g", "h", None]
    assert reports.selected_genre(df.drop("genre1")).where("selected_genre is null").count() == 3
    assert [(r.n, r.global_index) for r in reports.indexed(df, "section", ["n"]).orderBy("global_index").collect()] == [(2, 0), (1, 1), (3, 2)]
    assert reports.shown(df, 0).count() == reports.shown(df, -3).count() == 0 and reports.shown(df, 2).count() == 2
    assert reports.group_columns("both") == ("section", "genre1")
    with pytest.raises(ValueError):
        reports.group_columns("other")
    assert [one(spark, reports.term(F.col("t")), t=t) for t in ("推量（らしい）、x", "断定、だ", "可能")] == ["らしい", "断定", "可能"]
    reports.write_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    assert reports.from_json(reports.to_json(df), "section string, genre1 string, n long").exceptAll(df).count() == 0
    df.write.csv(f"{tmp_path}/c", header=True)
    assert reports.read_matches_csv(spark, f"{tmp_path}/c", "section string, genre1 string, n long").count() == 3
    assert one(spark, reports.valid_year(F.col("y")), y=1999) == 1999
    with pytest.raises(Exception, match="not a year"):
        one(spark, reports.valid_year(F.col("y")), y=-1)
    left, right = reports.common_rows([spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int"), spark.createDataFrame([("b", 3), ("c", 4)], "name string, x int")])
    assert [r.x for r in left.collect()] == [2] and [r.x for r in right.collect()] == [3]
    assert FINAL != CONNECTIVE
