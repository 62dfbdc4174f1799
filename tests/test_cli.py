from tsuzuri import cli


def test_extract_and_count(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"title":"t","genre":["g"],"sentences":["だから、明らかである。","また、よい。"]}\n', encoding="utf-8")
    cli.main(["extract", str(tmp_path / "c.jsonl"), str(tmp_path / "m")])
    assert {(r.expr, r.genre1) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("だから", "g"), ("また", "g")}
    cli.main(["count", str(tmp_path / "m"), str(tmp_path / "n")])
    assert spark.read.csv(str(tmp_path / "n"), header=True).count() == 2


def test_markdown_gets_its_sections(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\ngenre1: g\n---\n# 題\n\n## 1. はじめに\n\nだから、明らかである。\n\n## 2. 結論\n\nまた、よい。\n\n## 参考文献\n\nまた、文献。\n", encoding="utf-8")
    cli.main(["extract", str(tmp_path / "in"), str(tmp_path / "m")])
    assert {(r.expr, r.section, r.genre1) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("だから", "introduction", "g"), ("また", "conclusion", "g")}
