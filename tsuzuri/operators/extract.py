"""Marker extraction: lexicon entries against sentences, as native columns without a join or a shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsuzuri.operators.lexicon import CONNECTIVE, FINAL, FIXTURE, Entry

SPAN = "array<struct<start:int,stop:int,i:int>>"
WORDS = r"\(([A-Za-z]+(?:\|[A-Za-z]+)*)\)"
# Patterns that read only the first or the last characters of a text besides white space: words, and one more character.
AT_START = re.compile(r"(?:\(\?i\))?\^\\s\*" + WORDS + r"\(\?:\[\^\\p\{L\}\]\|\$\)")
AT_END = re.compile(r"(?:\(\?i\))?" + WORDS + r"\[\.!\?\]\?\\s\*\$")
# White space of ``\\s``, and the ends of lines that ``$`` passes over besides.
BLANKS, LINE_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")


def _empty() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _span(text: Column, entry: Entry, i: int, before: Column | None = None) -> Column:
    """struct(start, stop, i) of an entry's first match, of its first group if it has one; null without a match.

    ``before``: characters that stand before ``text``.
    """
    has_group = "(" in entry.pattern.replace("(?", "").replace("\\(", "")
    hit = F.regexp_extract(text, entry.pattern, 0)
    part = F.regexp_extract(text, entry.pattern, 1) if has_group else hit
    start = F.length(F.get(F.split(text, entry.pattern, 2), F.lit(0))) + F.position(part, hit) - 1
    start = start if before is None else start + before
    return F.when(text.rlike(entry.pattern), F.struct(start.cast("int").alias("start"), (start + F.length(part)).cast("int").alias("stop"), F.lit(i).alias("i")))


def candidates(text: Column, entries: Sequence[tuple[int, Entry]], before: Column | None = None) -> Column:
    if not entries:
        return _empty()
    spans = F.filter(F.array(*[_span(text, e, i, before) for i, e in entries]), lambda s: s.isNotNull())
    return spans


def _reach(form: re.Pattern, entries: Sequence[Entry]) -> int:
    """Most characters that patterns of a form read, white space aside; other patterns don't count."""
    found = [form.fullmatch(e.pattern) for e in entries]
    return 1 + max((len(w) for m in found if m for w in m[1].split("|")), default=0)


def _ends(text: Column, entries: Sequence[Entry]) -> Column:
    """struct(head, lead, tail, front): what patterns of the two forms read of a text, and the characters before it.

    A match of these patterns begins after the leading or ends before the trailing white space, so the few
    characters there give the matches of the whole text; a text whose ``$`` may pass over a line's end is kept whole.
    """
    left, right = F.ltrim(text, F.lit(BLANKS)), F.rtrim(text, F.lit(BLANKS))
    whole, most = F.right(right, F.lit(1)).isin(*LINE_ENDS), _reach(AT_END, entries)
    return F.struct(
        F.left(left, F.lit(_reach(AT_START, entries))).alias("head"),
        (F.length(text) - F.length(left)).alias("lead"),
        F.when(whole, text).otherwise(F.right(right, F.lit(most))).alias("tail"),
        F.when(whole, 0).otherwise(F.greatest(F.length(right) - most, F.lit(0))).alias("front"),
    )


def _all_candidates(text: Column, ends: str, entries: Sequence[tuple[int, Entry]]) -> Column:
    """Candidates of all entries: each group of patterns against what it reads, and only if the group's alternation matches."""
    form = lambda e: 0 if AT_START.fullmatch(e.pattern) else 1 if AT_END.fullmatch(e.pattern) else 2
    read = ((F.col(f"{ends}.head"), F.col(f"{ends}.lead")), (F.col(f"{ends}.tail"), F.col(f"{ends}.front")), (text, None))
    parts = []
    for k, (part, before) in enumerate(read):
        if mine := [(i, e) for i, e in entries if form(e) == k]:
            screen = part.rlike("|".join(f"(?:{e.pattern})" for _, e in mine))
            parts.append(F.when(screen, candidates(part, mine, before)).otherwise(_empty()))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def best_connective(spans: Column) -> Column:
    """At most one span: the earliest, then the longest."""
    order = F.array_min(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-(s["stop"] - s["start"])).alias("len"), s["i"].alias("i"))))
    kept = F.filter(spans, lambda s: (s["start"] == order["start"]) & (s["i"] == order["i"]))
    return F.when(F.size(spans) > 0, F.slice(kept, 1, 1)).otherwise(_empty())


def longest_first(spans: Column) -> Column:
    """Spans without overlap: longer ones first, earlier ones on ties."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["stop"]).alias("len"), s["start"].alias("start"), s["stop"].alias("stop"), s["i"].alias("i"))))
    plain = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["i"].alias("i")))
    return F.aggregate(plain, _empty(), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])), acc).otherwise(F.array_append(acc, x)))


def without_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Both sides without the spans that overlap one of the other side."""
    free = lambda own, other: F.filter(own, lambda x: ~F.exists(other, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))
    return free(a, b), free(b, a)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions refer to rather than repeat (a generator stops projections from merging)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def extract_matches(sentences: DataFrame, lexicon: Sequence[Entry] = tuple(FIXTURE), kinds: Sequence[str] = (CONNECTIVE, FINAL), text: str = "sentence_text", cross_check: bool = True, strict: bool = False) -> DataFrame:
    """One row for each marker: the sentence's columns, type, expr, func, subfunc, position, end_position, span_text, rel_position.

    Connectives: at most one a sentence; with ``strict``, only those before a comma.  Finals: longest first, without overlaps.  With
    ``cross_check``, a connective and a final that overlap are both dropped.
    """
    own = list(enumerate(lexicon))
    t = F.col(text)
    raw = []
    for kind in (CONNECTIVE, FINAL):
        mine = [(i, e) for i, e in own if e.type == kind]
        raw.append(_all_candidates(t, "__ends", mine) if kind in kinds and mine else _empty())
    df = _once(sentences, "__ends", _ends(t, lexicon))
    df = _once(df, "__raw", F.struct(raw[0].alias("ce"), raw[1].alias("sf")))
    df = df.where((F.size("__raw.ce") > 0) | (F.size("__raw.sf") > 0))
    first = before_comma(F.col("__raw.ce"), t) if strict else F.col("__raw.ce")
    df = _once(df, "__kept", F.struct(best_connective(first).alias("ce"), longest_first(F.col("__raw.sf")).alias("sf")))
    ce, sf = F.col("__kept.ce"), F.col("__kept.sf")
    if cross_check:
        ce, sf = without_overlap(ce, sf)
    facts = F.array(*[F.struct(F.lit(e.type).alias("type"), F.lit(e.name).alias("expr"), F.lit(e.function).alias("func"), F.lit(e.subclass).alias("subfunc")) for _, e in own])
    rows = _once(df.withColumn("__m", F.explode(F.concat(ce, sf))), "__f", F.get(facts, F.col("__m.i")))
    start, stop = F.col("__m.start"), F.col("__m.stop")
    rel = F.coalesce(F.try_divide(start.cast("double"), F.length(t)), F.lit(0.0))
    return rows.select("*", "__f.*", start.alias("position"), stop.alias("end_position"), F.substring(t, start + 1, stop - start).alias("span_text"), rel.alias("rel_position")).drop("__ends", "__raw", "__kept", "__m", "__f")


def match_tokens(tokens: Column, pattern: str) -> Column:
    """Matches (encoded tokens) of a compiled token pattern; ``tokens`` is an array of structs orth, norm, lemma, pos, tag, morph."""
    names = ("orth", "norm", "lemma", "pos", "tag", "morph")

    def joined(all_tokens: Column, field) -> Column:
        return F.array_join(F.transform(all_tokens, lambda k: F.concat(*[p for f in names for p in (field(k[f]), F.lit("|"))][:-1], F.lit(";"))), "")

    def coded(all_tokens: Column) -> Column:
        """Fields are cleaned one by one only where a separator is in any of them."""
        parts = [F.array_join(all_tokens[f], "") for f in names]
        clean = ~F.concat(*parts).rlike("[|;]")
        plain = lambda v: F.coalesce(v, F.lit(""))
        return F.when(clean, joined(all_tokens, plain)).otherwise(joined(all_tokens, lambda v: F.regexp_replace(plain(v), "[|;]", " ")))

    code = F.get(F.transform(F.array(tokens), coded), F.lit(0))  # an element of an array, so that tokens are made once
    return F.regexp_extract_all(code, F.lit(f"(?<![^;])({pattern})"), F.lit(1))


def escaped(s: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(plain), F.lit(code))
    return s


def highlight(text: Column, spans: Column) -> Column:
    """Escaped text with ``<mark>`` around spans, which must not overlap: array of struct(start, stop)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = escaped(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        inside = escaped(F.substring(text, s["start"] + 1, s["stop"] - s["start"]))
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], before, F.lit("<mark>"), inside, F.lit("</mark>")).alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], escaped(F.substring(text, acc["at"] + 1, F.length(text)))))


def highlight_both(text: Column, conn: Column, end: Column) -> Column:
    """Escaped text with classes ``conn``, ``end`` or, where spans of the two overlap, ``both``: arrays of struct(start, stop)."""
    n = F.length(text)
    ends = F.flatten(F.transform(F.concat(conn, end), lambda s: F.array(F.greatest(s["start"], F.lit(0)), F.least(s["stop"], n))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), ends)))
    parts = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    covers = lambda spans, p: F.exists(spans, lambda s: (s["start"] <= p["a"]) & (p["b"] <= s["stop"]))

    def shown(p: Column) -> Column:
        one, two = covers(conn, p), covers(end, p)
        kind = F.when(one & two, "both").when(one, "conn").when(two, "end")
        body = escaped(F.substring(text, p["a"] + 1, p["b"] - p["a"]))
        return F.when(kind.isNull(), body).otherwise(F.concat(F.lit('<span class="'), kind, F.lit('">'), body, F.lit("</span>")))

    return F.array_join(F.transform(F.filter(parts, lambda p: p["a"] < p["b"]), shown), "")


def keep_first(spans: Column) -> Column:
    """Spans without overlap by a sweep: earlier ones first, longer ones on ties."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["stop"]).alias("len"), s["stop"].alias("stop"), s["i"].alias("i"))))
    plain = F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["i"].alias("i")))
    return F.aggregate(plain, _empty(), lambda acc, x: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["stop"] <= x["start"]), F.array_append(acc, x)).otherwise(acc))


def before_comma(spans: Column, text: Column) -> Column:
    """Spans that a comma follows, as a strict search for connectives asks."""
    return F.filter(spans, lambda s: F.substring(text, s["stop"] + 1, F.lit(1)).isin(",", "、", "，"))


def spans_by_label(matches: DataFrame, by: str = "sentence_id", label: str = "expr") -> DataFrame:
    """``by`` and a map from each label to its spans, sorted."""
    one = matches.groupBy(by, label).agg(F.array_sort(F.collect_list(F.struct("position", "end_position"))).alias("spans"))
    return one.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("spans"))))).alias("spans"))


def expand_functions(df: DataFrame, col: str = "func", kind: str = "type") -> DataFrame:
    """func_1..func_3: cumulative levels of a connective's function; first word and whole of a final's class."""
    f = F.translate(F.coalesce(F.col(col), F.lit("")), "０１２３４５６７８９", "0123456789")
    code = F.regexp_extract(f, r"^(\d+)", 1)
    tags = F.filter(F.split(F.regexp_replace(f, r"^\d+", ""), r"(?U)[・、,/／;；|\s+]"), lambda x: x != "")
    level = lambda n: F.when(F.size(tags) >= n, F.concat(code, F.array_join(F.slice(tags, 1, n), "・")))
    connective = (F.col(kind) == CONNECTIVE) if kind in df.columns else F.lit(True)
    words = F.filter(F.split(f, r"(?U)[・、,/／;；|\s+]"), lambda x: x != "")
    return df.withColumns(
        {
            "func_1": F.when(connective, level(1)).otherwise(F.get(words, F.lit(0))),
            "func_2": F.when(connective, level(2)).otherwise(F.when(F.size(words) > 0, F.array_join(words, ""))),
            "func_3": F.when(connective, level(3)),
        }
    )
