import random
import time

from tsuzuri.llm import html_template

rng = random.Random(9)
WORDS = [f"word{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def pages(host, n, article):
    out = []
    for i in range(n):
        title, body = prose(4), [prose(rng.randint(30, 60)) for _ in range(rng.randint(2, 5))]
        page = f"""<html><body><div class="layout with-sidebar"><form id=page><div class=t1><a href=1>{prose(2)}</a> All rights here</div>
        <{article}><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}<div class="share">tell</div></{article.split()[0]}>
        <div class=t2><p>{prose(3)}</p></div></form></div></body></html>"""
        out.append((f"https://{host}/{i}", page, "\n".join([title, *body])))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in html_template.extract(df).orderBy("page_id").collect()]


def test_slots_decide_and_not_names(spark):
    rows = pages("a.example", 8, 'article class="market-share"') + pages("b.example", 8, "section id=x") + pages("c.example", 8, "div")
    assert run(spark, rows) == [t for _, _, t in rows]
    assert html_template.main_text(rows[9][1], None, None) != rows[9][2]  # the names alone do not tell


def test_small_hosts_take_the_slot_of_like_pages(spark):
    rows = pages("a.example", 9, "section") + [pages(f"h{i}.example", 1, "section")[0] for i in range(3)]
    assert run(spark, rows) == [t for _, _, t in rows]


def test_texts_of_all_pages_are_template(spark):
    rows = [(f"https://d.example/{i}", f"<body><div><p>{(a := prose(40))}</p><p>Read more about us on our pages</p><p>{(b := prose(20))}</p></div></body>", f"{a}\n{b}") for i in range(6)]
    assert run(spark, rows) == [t for _, _, t in rows]


def test_broken_and_odd_pages(spark):
    text = html_template.main_text
    assert text("<p>a <math><mi>x</mi><mo>=</mo>2</math> b<p>c", None, None) == "a x=2 b\nc"
    assert "rest" in text("<p>a<object data=x>rest<p>more", None, None) and "side" not in text("<svg><svg>in</svg>side</svg>b", None, None)
    assert text("<svg>open <p>kept", None, None).endswith("kept") and text("<p>x<script>lost <p>gone", None, None) == "x"
    began = time.time()
    deep = "<div>" * 100_000 + "low" + "</div>" * 100_000
    assert text(deep, None, None) == "low" and text("<x-a>" * 20_000 + "<p>y" * 2000, None, None).count("y") == 2000
    assert time.time() - began < 20
    df = spark.createDataFrame([(1, None, None), (None, "u", ""), (3, "u", "<p>t"), (3, "u", "<p>t"), (4, "https://deep.example", deep)], "page_id long, url string, html string").selectExpr("*", "'x' host", "1 token")
    assert sorted((str(r.page_id), r.text) for r in html_template.extract(df).collect()) == [("1", ""), ("3", "t"), ("3", "t"), ("4", "low"), ("None", "")]
    assert html_template.extract(df.where("false")).count() == 0
