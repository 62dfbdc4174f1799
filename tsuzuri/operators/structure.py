"""Document structure: heading classes, heading trees, offsets and runs, as windows and array functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tsuzuri.functions.text import ascii_digits, strip

# Ordered heading rules (label, pattern); the last rule of a label gives its priority.
RULES = (
    ("hypotheses", "理論仮説|仮説モデル"),
    ("methods", "推計モデル|モデル設定"),
    ("discussion", "頑健性の確認|ロバストネス確認"),
    ("conclusion", "むすび"),
    ("introduction", r"^(?:I{1,3}|IV|V|VI{0,3}|X{1,2})\s*(?:\.\s*)?(?:はじめに|緒言|序論)"),
    ("position", "位置づけ|位置付け"),
    ("results_discussion", "結果[お及びと]?考察|考察と結果|まとめと考察"),
    ("keywords", "キーワード|keywords?"),
    ("abstract", "要旨|概要|抄録|アブストラクト|abstract|要約"),
    ("toc", "目次|contents?"),
    ("literature_review", "先行研究|関連研究|既往研究|研究史"),
    ("introduction", "はじめ|初め|始め|序論|緒言|導入|序|問題の所在|問題設定|問題提起|背景|研究の背景|研究背景|問題意識|研究目的|研究の目的|本稿の目的|目的と背景|目的"),
    ("methods", "方法論|方法|手法|研究方法|研究の方法|調査方法|調査の方法|分析方法|実験方法|推定方法|対象と方法|データと方法|モデルと推定方法|研究デザイン|手続き|実験手続|実験の手続き|実験の概要|調査概要|調査の概要|調査(?:地(?:および)?)?(?:および調査)?の概要"),
    ("data", "使用するデータ|データ説明|データと変数|分析データ|データ|資料|史料|材料|文献調査"),
    ("discussion", "結果の解釈|解釈"),
    ("results", "推定結果|実験結果|分析結果|結果の概要|結果|検証結果"),
    ("discussion", "ディスカッション|総合考察|調査結果の考察|要約と議論|分析と考察|議論|考察|分析"),
    ("conclusion", "結論と展望|結語|結言|結びにかえて|結びに代えて|むすびに(?:か|代)えて|むすび|終わりに|おわりに|最後に|小括|小結|結び|まとめ|結論"),
    ("future_work", "今後の研究課題|本稿の限界と今後の課題|本研究の限界と今後の課題|結論と今後の課題|まとめと課題|おわりに今後の課題|今後の課題|展望"),
    ("acknowledgments", "謝辞|感謝"),
    ("notes", "注及び引用・参考文献|補注|注記|註|注"),
    ("references", r"引用・?参考文献|参照文献|文献一覧|文献表|文献リスト|参考引用文献|引用資料|引用文献|参考文献|英語文献|巻末資料|\A文献\z"),
    ("appendix", "付表|補遺|付記|付録"),
    ("author_bio", "執筆者紹介|プロフィール|著者紹介"),
    ("hypotheses", "仮説の検証|仮説設定|仮説提示|仮説"),
)
PRIORITY = {label: i for i, (label, _) in enumerate(RULES)}
PARENTS = {"hypotheses": "introduction", "position": "introduction"}
PROPAGATED = ("hypotheses", "future_work", "acknowledgments", "notes", "abstract", "appendix", "literature_review")
HEAD = 30
NUMBER = r"^\s*(?:第?[0-9０-９]+(?:[.．][0-9０-９]+)*[章節.．、)）]?|[①-⑳]|[IVX]+[.．]|[（(][0-9０-９]+[)）]|[一二三四五六七八九十]+[、.．])\s*"
KANA_OR_WORD = "一-鿿ァ-ヶーA-Za-z0-9"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_prefix(heading: Column) -> Column:
    found = strip(F.regexp_extract(F.regexp_replace(heading, r"([0-9]+)\.\s+([0-9]+)", "$1.$2"), NUMBER, 0))
    return F.when(found != "", found)


def heading_labels(heading: Column) -> Column:
    """Sorted labels of a heading: the longest matches count, of equal ones those at its start; ``references`` excludes the others.

    A match inside the first ``HEAD`` characters counts unless kanji, katakana or a letter stands before it.
    """
    whole = F.substring(strip(F.regexp_replace(F.regexp_replace(heading, r"([0-9]+)\.\s+([0-9]+)", "$1.$2"), NUMBER, "")), 1, HEAD)
    hit = lambda n, at, label: F.struct(n.alias("n"), F.lit(at).alias("anchored"), F.lit(label).alias("label"))

    def hits(body: Column) -> Column:
        rows = []
        for label, pattern in RULES:
            first = F.length(F.regexp_extract(body, f"(?i)^(?:{pattern})", 0))
            inside = F.length(F.regexp_extract(body, f"(?i)(?<![{KANA_OR_WORD}])(?:{pattern})", 0))
            joined = F.length(F.regexp_extract(body, f"(?i)(?:と|の|及び|および|・)((?:{pattern}))", 1))
            size = F.greatest(inside, joined)
            rows.append(F.when(first > 0, hit(first, 1, label)).when(size > 0, hit(size, 0, label)))
        return F.filter(F.array(*rows), lambda x: x.isNotNull())

    def longest(found: Column) -> Column:
        best = F.array_max(F.transform(found, lambda x: F.struct(x["n"].alias("n"), x["anchored"].alias("anchored"))))
        kept = bound(best, lambda b: F.filter(found, lambda x: (x["n"] == b["n"]) & (x["anchored"] == b["anchored"])))
        references = F.exists(found, lambda x: x["label"] == "references")
        return F.when(references, F.array(F.lit("references"))).otherwise(F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["label"]))))

    return bound(bound(whole, hits), longest)


def with_parents(labels: Column) -> Column:
    """Labels with their parent classes."""
    more = [F.when(F.array_contains(labels, c), F.array(F.lit(p))).otherwise(F.expr("cast(array() as array<string>)")) for c, p in PARENTS.items()]
    return F.array_sort(F.array_union(labels, F.array_distinct(F.concat(*more))))


def primary_label(labels: Column) -> Column:
    """A parent class first, then the label of the smallest priority."""
    order = F.create_map(*[F.lit(x) for label, i in PRIORITY.items() for x in (label, i + (0 if label in PARENTS.values() else 100))])
    return F.array_min(F.transform(labels, lambda c: F.struct(order[c].alias("p"), c.alias("c"))))["c"]


def tree(nodes: DataFrame, doc: str = "doc", at: str = "idx", level: str = "level", start: str = "start", doc_len: str = "doc_len") -> DataFrame:
    """parent (nearest earlier node of a smaller level), stop (start of the next node whose level is no deeper, else the document's length), smooth (no jump by more than one level).

    One pass with a stack over each document's nodes.
    """
    kind = lambda c: nodes.schema[c].dataType
    schema = StructType([*nodes.schema.fields, StructField("parent", kind(at)), StructField("stop", kind(start)), StructField("smooth", LongType())])

    whole = isinstance(kind(at), (LongType, IntegerType))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable")
        levels, places, starts = rows[level].tolist(), rows[at].tolist(), rows[start].tolist()
        parent, stop, smooth, stack, least = [None] * len(rows), rows[doc_len].tolist(), [], [], None
        for i, own in enumerate(levels):
            while stack and levels[stack[-1]] >= own:
                stop[stack.pop()] = starts[i]
            parent[i] = places[stack[-1]] if stack else None
            stack.append(i)
            least = own - i if least is None else min(least, own - i)
            smooth.append(i + least)
        return rows.assign(parent=pd.array(parent, "Int64") if whole else parent, stop=stop, smooth=smooth)

    return nodes.groupBy(doc).applyInPandas(walk, schema)


def propagate(nodes: DataFrame, doc: str = "doc", at: str = "idx", labels: str = "labels") -> DataFrame:
    """``labels`` with the propagatable ones of the immediate children, and parent classes."""
    own = F.array(*[F.lit(x) for x in PROPAGATED])
    given = nodes.where("parent is not null").groupBy(F.col(doc).alias("__d"), F.col("parent").alias("__p")).agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect(labels, own)))).alias("__g"))
    out = nodes.join(given, (F.col(doc) == F.col("__d")) & (F.col(at) == F.col("__p")), "left")
    return out.withColumn(labels, with_parents(F.array_union(labels, F.coalesce("__g", F.expr("cast(array() as array<string>)"))))).drop("__d", "__p", "__g")


def without_intervals(text: Column, intervals: Column) -> Column:
    """The pieces of ``text`` outside intervals (array of struct(start, stop))."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    pieces = F.aggregate(F.array_sort(intervals), start, step, lambda acc: F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.filter(pieces, lambda p: p != "")


def places(text: Column, pattern: str) -> Column:
    """The intervals (array of struct(start, stop)) of a pattern's leftmost matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, b: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["b"]
        e = s + x["m"]
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("stop"))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def offsets(blocks: DataFrame, by: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """start of each block in the text that joins all blocks of a document with ``gap`` characters between."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0)))


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of equal neighbours: by, run, value, rows of the run."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w)).groupBy(by, "run", value).agg(F.count("*").alias("n"))


def heading_like(text: Column) -> Column:
    """Whether a line looks like a heading."""
    t = strip(ascii_digits(text))
    return (F.length(t) > 0) & (F.length(t) <= 120) & ~t.rlike("[。．！？!?]") & ~t.rlike("[①-⑳]") & (F.length(F.regexp_replace(t, "[^、，,]", "")) <= 1) & ~t.rlike("(?:する|した|である|ます|です|いる)$") & ((F.length(t) <= 40) | t.rlike("[:：—–-]"))


def heading_prefix_style(heading: Column) -> Column:
    """Style of a heading's number: parenthesis, circled, dot, roman, kanji, plain, other or none."""
    p = number_prefix(heading)
    return (
        F.when(p.isNull(), "none")
        .when(p.rlike("^[（(]"), "parenthesis")
        .when(p.rlike("^[①-⑳]"), "circled")
        .when(p.rlike("[0-9０-９][.．][0-9０-９]"), "dot")
        .when(p.rlike("^[IVX]+"), "roman")
        .when(p.rlike("^[一二三四五六七八九十]+"), "kanji")
        .when(p.rlike("^[0-9０-９]+"), "plain")
        .otherwise("other")
    )


def numeric_components(heading: Column) -> Column:
    """How many numbers a heading's number has: 2 for 3.1."""
    return F.size(F.regexp_extract_all(F.coalesce(number_prefix(heading), F.lit("")), F.lit("([0-9０-９]+)"), F.lit(1)))


def author_like(line: Column) -> Column:
    """Whether a line names authors: an affiliation or bracketed names."""
    t = strip(line)
    return (F.length(t) > 0) & (F.length(t) <= 80) & (t.rlike("大学|研究所|研究科|学部|大学院|学会|センター|株式会社") | t.rlike(r"^[^（(]{1,20}[（(][^）)]{1,40}[）)]$"))


def line_ranges(text: Column) -> Column:
    """Array of struct(line, start, stop) of the lines of a text that are not blank."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    sizes = F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.rlike(r"\S").alias("full")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.expr("cast(array() as array<struct<line:int,start:int,stop:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(acc["i"].alias("line"), acc["at"].alias("start"), (acc["at"] + x["n"]).alias("stop"))
        return F.struct((acc["at"] + x["n"] + 1).alias("at"), (acc["i"] + 1).alias("i"), F.when(x["full"], F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def sentence_of(text: Column, position: Column) -> Column:
    """struct(sentence, body) of the line that holds a position; -1 and null where none does."""
    hit = F.get(F.filter(line_ranges(text), lambda x: (x["start"] <= position) & (position < x["stop"])), F.lit(0))
    return F.struct(F.coalesce(hit["line"], F.lit(-1)).alias("sentence"), F.when(hit.isNotNull(), F.substring(text, hit["start"] + 1, hit["stop"] - hit["start"])).alias("body"))
