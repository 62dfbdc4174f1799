import random
import re

import pytest
from pyspark.sql import functions as F

from tsuzuri.functions import text as tx
from tsuzuri.operators import extract, lexicon, reports, search, sections, stats
from tsuzuri.operators.lexicon import CONNECTIVE, FINAL, FIXTURE
from tsuzuri.plans import catalogue


def written(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_matches_do_not_repeat_texts(spark, tmp_path):
    lines = ["\n".join(f"the line {i} {random.Random(i * 1000 + k).random()} is ending" for k in range(300)) for i in range(8)]
    kept = catalogue.found_once(spark, written(spark, tmp_path, lines))
    longest = max(kept.where("sentence_id is not null").select(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in kept.columns]).first())
    assert kept.count() == 2 * 300 * 8 and longest < 30  # each paragraph has 10,000 characters


def test_matches_are_found_once_for_both_sides(spark, tmp_path):
    d = written(spark, tmp_path, ["the first is ending\nof and\nthe last is done", "que la the\nand walking"])
    for name in ("pairs_distinct", "pairs_multiset", "overlap_invalidate", "surface_forms_sf", "surface_forms_conn"):
        assert len(re.findall(r"Window \[", plan_of(catalogue.queries()[name](spark, d)))) == 1, name


def test_side_by_side_is_the_join(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([CONNECTIVE, FINAL, FINAL, "x", None]), rng.choice(["a", "b", None]), rng.randrange(3), rng.choice(["A", None]), "s") for _ in range(60)]
    df = spark.createDataFrame(rows, "sentence_id long, type string, expr string, position int, span_text string, section string")
    ce, sf = [r for r in rows if r[1] == CONNECTIVE and r[0]], [r for r in rows if r[1] == FINAL]
    want = sorted(repr((a[0], a[2], a[3], b[2], b[3])) for a in ce for b in sf if a[0] == b[0])
    got = stats.pairs(df, False).select("sentence_id", "conn", "conn_pos", "final", "final_pos").collect()
    assert sorted(repr(tuple(r)) for r in got) == want != []
    forms = search.surface_forms(df, FINAL).agg(F.sum("n")).first()[0]
    assert forms == len(want) == reports.collocation_column(df).count()


def test_ends_of_a_text_give_the_matches_of_the_whole(spark):
    rng = random.Random(11)
    words = ["the", "THE", "Der", "ending", "tion", "MENT", "is", "and", "\u00e9", "\u65e5\u672c", "x", "\U0001f600", "de", "en", "th"]
    gaps = [" ", "\t", "\x0b", "  ", ". ", "\n", "!", "?", ",", "", "\x85", "\u2028", "\u2029", "\r\n", "\xa0"]
    texts = ["", " ", "the", "ment", "ment.", " \t the", "ment. \n", "ment\u2028", "tion.\u2028", "tion. \u2028", "ment\u2028 ", "ment\x85\n", "ed.. ", "\U0001f600ment?", "\xa0the"]
    texts += ["".join(rng.choice(gaps) + rng.choice(words) for _ in range(rng.randrange(1, 6))) + rng.choice(gaps) + rng.choice(gaps) for _ in range(600)]
    own = list(enumerate(FIXTURE))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.explode(F.array(extract._ends(F.col("t"), FIXTURE))).alias("e"))
    got = df.select("t", extract._all_candidates(F.col("t"), "e", own).alias("s"), extract.candidates(F.col("t"), own).alias("whole"), F.length("e.head").alias("h")).collect()
    assert max(r.h for r in got) <= 5
    for r in got:
        assert sorted(r.s) == sorted(r.whole), repr(r.t)
    assert sum(bool(r.s) for r in got) > 200


def test_long_sentences_are_not_searched_for_words_at_their_ends(spark):
    """Patterns of the bundled lexicon read a few characters; others the whole text."""
    assert all(extract.AT_START.fullmatch(e.pattern) or extract.AT_END.fullmatch(e.pattern) for e in FIXTURE)
    assert not any(extract.AT_START.fullmatch(e.pattern) or extract.AT_END.fullmatch(e.pattern) for e in lexicon.connectives())
    assert extract.AT_END.fullmatch(r"(?i)(a.b)[.!?]?\s*$") is None and extract.AT_START.fullmatch(r"^\s*(a )(?:[^\p{L}]|$)") is None
    text = "the " + "word " * 200_000 + "walking.  "
    got = {(r.expr, r.position, r.span_text) for r in extract.extract_matches(spark.createDataFrame([(text,)], "sentence_text string")).collect()}
    assert got == {("the", 0, "the"), ("ing", len(text) - 6, "ing")}


def test_counts_are_read_once(spark, tmp_path):
    d = written(spark, tmp_path, ["the first is ending\nof and\nthe last is done", "que la the\nand walking\nof the moment"])
    counts = stats.contingency(catalogue.found(spark, d), "section")
    assert "Window" not in plan_of(stats.chi2_residuals(counts)) and "Window" in plan_of(counts)


@pytest.mark.parametrize("text", [None, "", " 、。", "あ", "abc", "あ" * 21 + "x" * 90, "あいう、えおabc", "a" * 101, "あ" * 7 + "abcd", "あ" * 6 + "xxxxx"])
def test_cjk_sizes_are_made_once(spark, text):
    body = "".join(c for c in text or "" if c not in "、。 ")
    n = sum(c in "あいうえお" for c in body)
    want = bool(text) and bool(body) and ((len(body) <= 10 and n >= 1) or (len(text) > 100 and n > 20) or n / len(body) >= 0.6)
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.mostly_cjk(F.col("t")).alias("x")).first().x == want
    assert df.select(tx.cjk_share(F.col("t")).alias("x")).first().x == pytest.approx(n / len(body) if body else 0)
    shown = plan_of(df.where(tx.mostly_cjk(F.translate("t", "a", "あ"))))
    assert shown.count("translate(") == 1 and shown.count("regexp_replace(") == 2


def test_sections_take_many_documents_a_batch(spark):
    docs = spark.createDataFrame([(i, f"# はじめに\n\ntext {i}\n\n# 結論\n\nend" if i % 3 else None if i % 2 else "plain") for i in range(300)], "k long, text string")
    out = sections.nodes(docs, "k")
    assert "FlatMapGroupsInPandas" not in plan_of(out)
    rows = out.collect()
    assert len({r.k for r in rows}) == 250 and {r.body for r in rows if r.k == 7} == {"text 7", "end"}
    assert [r.category for r in rows if r.k == 0] == ["unknown"]


def test_fields_with_separators_are_cleaned(spark):
    tok = lambda *w: [(a, a, a, None, "", "") for a in w]
    rows = spark.createDataFrame([(tok("a|b", "c;d", "e"),)], "t array<struct<orth:string,norm:string,lemma:string,pos:string,tag:string,morph:string>>")
    got = rows.select(extract.match_tokens(F.col("t"), lexicon.compile_tokens([{"ORTH": "a b"}, {"ORTH": "c d"}])).alias("m")).first().m
    assert got == ["a b|a b|a b|||;c d|c d|c d|||;"]
