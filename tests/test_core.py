import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsuzuri.functions import text as tx
from tsuzuri.operators import extract, lexicon, network, search, segment, stats, structure
from tsuzuri.operators.lexicon import CONNECTIVE, FINAL, Either


def test_keyness_and_chi2_golden(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "x"), ("B", "y"), ("B", "y")], "section string, expr string")
    got = {r.expr: r for r in stats.llr_keyness(rows, "A", min_count=1).collect()}
    assert got["x"].llr == pytest.approx(0.3397980736, abs=1e-9) and got["x"].p == pytest.approx(0.5599458009, abs=1e-9)
    assert got["y"].target_rel == pytest.approx(-1 / 3)
    s = stats.chi2_summary(stats.contingency(rows, "section")).first()
    assert (s.chi2, s.dof, s.cramers_v) == (pytest.approx(2 / 3), 1, pytest.approx(1 / 3))
    assert stats.chi2_sf(2 / 3, 1) == pytest.approx(0.4142161782, abs=1e-9)
    total = sum(stats.correspondence(stats.contingency(rows, "section"))[2])
    assert total == pytest.approx(s.chi2 / s.n)


def test_pmi_golden(spark):
    say = {1: "ax", 2: "ax", 3: "ay", 4: "by", 5: "b"}
    rows = [(k, CONNECTIVE if c in "ab" else FINAL, c, i) for k, v in say.items() for i, c in enumerate(v)]
    got = {(r.conn, r.final): r for r in stats.pmi_entropy(spark.createDataFrame(rows, "sentence_id long, type string, expr string, position int")).collect()}
    assert got["a", "x"].joint == 2 and got["a", "x"].pmi == pytest.approx(0.7369655942)
    assert got["a", "y"].pmi == pytest.approx(-0.2630344058) and got["b", "y"].transition == pytest.approx(0.5)
    assert got["a", "x"].conn_entropy == pytest.approx(0.9182958341) and got["b", "y"].final_entropy == pytest.approx(1.0)


def test_network_running_golden(spark):
    rows = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "A"), (2, 1, "A"), (2, 2, "B")], "s long, i long, e string")
    ev = network.edge_events(rows, ["s"], ["i"], "e")
    got = {(r.src, r.dst): (r.weight, round(r.pmi, 9)) for r in network.running_edges(ev, ["s", "i"]).collect()}
    assert got == {("A", "B"): (2, -0.584962501), ("B", "A"): (1, -1.0)}
    assert {r.node: r.frequency for r in network.nodes(rows, ev, "e").collect()} == {"A": 6, "B": 5}
    assert [r.value for r in network.pajek(network.edges(ev)).collect()][:2] == ["*vertices 2", '1 "A"']


def test_bh_golden(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r.k: round(r.p_adj, 7) for r in stats.adjust(rows, F.col("p")).collect()}
    assert got == {"a": 0.04, "b": 0.0533333, "c": 0.0533333, "d": 0.5}


def test_tree_matches_a_stack(spark):
    rng = np.random.default_rng(3)
    rows = [(d, i, int(rng.integers(1, 6)), 10 * i, 200) for d in range(40) for i in range(12)]
    got = {(r.doc, r.idx): r for r in structure.tree(spark.createDataFrame(rows, "doc long, idx long, level long, start long, doc_len long")).collect()}
    for d in range(40):
        stack, smooth = [], 0
        own = [r for r in rows if r[0] == d]
        for n, (_, i, level, start, _) in enumerate(own):
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[d, i].parent == (stack[-1][0] if stack else None)
            stack.append((i, level))
            assert got[d, i].stop == next((s for _, _, lv, s, _ in own[n + 1 :] if lv <= level), 200)
            smooth = min(level, smooth + 1) if n else level
            assert got[d, i].smooth == smooth


def test_headings_and_propagation(spark):
    rows = spark.createDataFrame([(x,) for x in ("はじめに", "結論", "参考文献", "3. 研究の仮説と目的", "注", "")], "h string")
    got = {r.h: r for r in rows.select("h", structure.with_parents(structure.heading_labels(F.col("h"))).alias("l"), structure.number_prefix(F.col("h")).alias("n")).collect()}
    assert got["はじめに"].l == ["introduction"] and got["参考文献"].l == ["references"] and got["注"].l == ["notes"] and got[""].l == []
    assert {"hypotheses", "introduction"} <= set(got["3. 研究の仮説と目的"].l) and got["3. 研究の仮説と目的"].n == "3."
    nodes = spark.createDataFrame([(1, 6, None, ["discussion"]), (1, 7, 6, ["future_work", "methods"])], "doc long, idx long, parent long, labels array<string>")
    assert {r.idx: r.labels for r in structure.propagate(nodes).collect()}[6] == ["discussion", "future_work"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.collapse_cjk_space(F.lit("日 本 語 abc"))) == "日本 語 abc"
    assert [one(tx.prefix_number(F.lit(s))) for s in ("３．", "③", "XIV.", "二十一、")] == [3, 3, 14, 21]
    assert one(tx.mostly_cjk(F.lit("これは日本語です"))) and not one(tx.mostly_cjk(F.lit("plain words")))
    assert one(tx.split_keywords(F.lit("a、b; c　d"))) == ["a", "b", "c", "d"]
    assert one(structure.without_intervals(F.lit("0123456789AB"), F.expr("array(struct(7 as start, 9 as stop), struct(3 as start, 5 as stop))"))) == ["012", "56", "9AB"]


def test_longest_first_and_overlap(spark):
    spans = F.expr("array(struct(0 as start, 2 as stop, 0 as i), struct(1 as start, 5 as stop, 1 as i), struct(5 as start, 6 as stop, 2 as i), struct(4 as start, 6 as stop, 3 as i))")
    got = spark.range(1).select(extract.longest_first(spans).alias("x")).first().x
    assert [(s.start, s.stop) for s in got] == [(1, 5), (5, 6)]


def test_japanese_connectives(spark):
    text = [("だから、結論は明らかである。",), ("また、分析結果は興味深い。",), ("これはだから、違う。",)]
    got = extract.extract_matches(spark.createDataFrame(text, "sentence_text string"), lexicon.connectives())
    assert {(r.sentence_text[:2], r.expr, r.position) for r in got.collect()} == {("だか", "だから", 0), ("また", "また", 0)}
    assert len(lexicon.connectives()) == 34


def test_token_patterns(spark):
    rx = lexicon.compile_tokens([{"LEMMA": "だ"}, Either(({"ORTH": "と"}, [{"ORTH": "の"}, {"POS": {"IN": ["AUX"]}}])), {"NORM": {"NOT_IN": ["x"]}, "OP": "?"}])
    tok = lambda *w: [(a, a, a, p, "", "") for a, p in w]
    rows = spark.createDataFrame([(tok(("だ", "AUX"), ("と", "ADP")),), (tok(("だ", "AUX"), ("x", "X")),)], "t array<struct<orth:string,norm:string,lemma:string,pos:string,tag:string,morph:string>>")
    assert [len(r.m) for r in rows.select(extract.match_tokens(F.col("t"), rx).alias("m")).collect()] == [1, 0]
    a, b = {"ORTH": "a"}, {"ORTH": "b"}
    assert sorted(map(len, lexicon.expand([a, Either((a, [b, a]))]))) == [2, 3]
    assert lexicon.names_of("そのあと、そのご（その後）") == {"そのあと", "そのご", "そのご（その後）", "そのあと、そのご", "その後"}


def test_sampling_and_highlight(spark):
    rows = spark.createDataFrame([(i, "s" if i % 2 else "t", f"g{i % 3}") for i in range(60)], "basename long, section string, genre1 string")
    got = search.sample_by_section(rows, 7, balance="genre1").groupBy("section").count().collect()
    assert {r["count"] for r in got} == {7} and search.sample_by_section(rows, 0).count() == 0
    spans = F.expr("array(struct(2 as start, 3 as stop))")
    assert spark.range(1).select(extract.highlight(F.lit("a<b>"), spans).alias("x")).first().x == "a&lt;<mark>b</mark>&gt;"


def test_segments_and_long_text(spark):
    rows = spark.createDataFrame([(1, ""), (2, "x" * 130)], "basename long, text string")
    assert segment.segments(rows).groupBy("basename").count().orderBy("basename").collect()[1]["count"] == 3
    parts = spark.range(1).select(segment.split_long(F.lit("ああ。いい。うう。"), 20).alias("x")).first().x
    assert parts == ["ああ。いい。", "うう。"]


def test_repartition_invariance(spark):
    rows = spark.createDataFrame([(i, "en", "g", "the cat is walking\nand so\nof the\n") for i in range(20)], "basename long, section string, genre1 string, text string")
    counts = lambda df: {tuple(r) for r in stats.count_by(extract.extract_matches(segment.sentences(df))).collect()}
    assert counts(rows.repartition(1)) == counts(rows.repartition(8)) != set()


def test_procrustes_and_mantel():
    a = np.random.default_rng(1).random((6, 2))
    turn = np.array([[0, 1], [-1, 0]])
    assert stats.procrustes(a, a @ turn * 3 + 2)[0] == pytest.approx(0, abs=1e-12)
    assert stats.mantel(a, a @ turn)[0] == pytest.approx(1)
    assert math.isclose(stats.chi2_sf(5.991464547, 2), 0.05, abs_tol=1e-9)
