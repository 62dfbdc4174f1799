import re

from tsuzuri.plans import catalogue


def test_exclusive_bodies_hold_whole_pages(spark, tmp_path):
    long = "<html><script>var t='</p>';</script>é<nav class=x><ul>1</ul></nav\n><p>" + "body 日本 " * 100 + "<STYLE>p{}</Style><p>end<script>open"
    pages = [(1, long), (2, "short"), (3, ""), (4, None), (5, "<navy>a</navy>" + "<nav>x</nav>" * 30)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.body for r in catalogue.queries()["exclusive_bodies"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else re.sub(r"(?is)<(script|style|nav)\b.*?</\1\s*>", "", t) for k, t in pages}
    assert got[1].endswith("<p>end<script>open") and got[2] == "short"
