"""Markdown documents to labelled sections: headings, levels, tree, labels and the text that is each section's own.

Blocks are classified by native columns; one exchange brings a document's blocks together, and one pass with a stack over
them makes its sections. A document is the unit of memory; nothing is held across documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsuzuri.functions.text import mostly_cjk, prefix_number, strip
from tsuzuri.operators import structure
from tsuzuri.operators.segment import EXCLUDED
from tsuzuri.sources import corpus

# Labels of sections that stand beside the main ones, and captions that are no headings.
TOP_LEVEL = ("references", "appendix", "toc", "abstract", "acknowledgments", "author_bio", "notes")
CAPTION = r"(?i)^\s*(?:図|表|写真|figure|fig\.|table)\s*[0-9０-９一二三四五六七八九十]"
HYPOTHESIS = r"^\s*(?:作業)?仮説\s*[0-9０-９]+"
ANCHOR_STYLES = ("roman", "dot", "plain")
LEAST_ANCHORS, MANY_ANCHORS = 3, 5
BASE = 2
GAP = "\n\n"
#: Documents that a worker takes out of an Arrow batch at a time.
SLICE = 128

NODE = "idx int, level int, heading string, number string, labels array<string>, category string, parent int, path array<string>, start long, stop long, body string, shown boolean"


def repaired_prefix(prefix: Column) -> Column:
    """A number prefix with misread signs put right: l and L as I in roman numerals, O as 0 beside digits."""
    core = F.regexp_replace(prefix, r"[\s.．、)）]", "")
    return F.when(core.rlike("^[IVXLivxl]+$"), F.translate(F.upper(prefix), "L", "I")).when(core.rlike("[0-9]") & core.rlike("^[0-9Oo]+$"), F.translate(prefix, "Oo", "00")).otherwise(prefix)


def headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` (of ``corpus.markdown_blocks``) with is_heading, prefix, number, style, parts, labels and anchor.

    A heading is a header block, or a paragraph of one line that looks like a heading and has a label. Captions are none.
    """
    body = F.col("body")
    maybe = ((F.col("kind") == "header") | ((F.col("kind") == "para") & ~body.contains("\n") & structure.heading_like(body))) & ~body.rlike(CAPTION)
    df = blocks.withColumn("labels", F.when(maybe, structure.heading_labels(body)))
    df = df.withColumn("is_heading", F.coalesce(maybe & ((F.col("kind") == "header") | (F.size("labels") > 0)), F.lit(False)))
    prefix = repaired_prefix(structure.number_prefix(body))
    head = lambda c: F.when(F.col("is_heading"), c)
    return df.select(
        "*",
        head(prefix).alias("prefix"),
        head(prefix_number(prefix)).alias("number"),
        head(structure.heading_prefix_style(body)).alias("style"),
        head(structure.numeric_components(body)).alias("parts"),
        head(structure.author_like(body)).alias("author"),
        head(body.rlike(HYPOTHESIS)).alias("hypothesis"),
    )


def _anchored(heads: list[dict]) -> bool:
    """Whether numbered headings are plain enough to be the sections of the first level."""
    numbers = [h["number"] for h in heads if h["number"] is not None]
    if len(heads) < LEAST_ANCHORS or numbers and len(set(numbers)) < 2 and len(heads) < MANY_ANCHORS:
        return False
    rising = sum(b > a for a, b in zip(numbers, numbers[1:]))
    return not numbers or rising >= max(1, len(numbers) // 2)


def _levels(heads: list[dict]) -> None:
    """Set ``level`` of headings: header signs, else parts of the number; the shallowest is ``BASE``, none jumps by more than one.

    Numbers of one part become ``BASE`` where they rise like those of sections; of labels of ``TOP_LEVEL`` all headings do.
    """
    for h in heads:
        h["level"] = int(h["level"] or BASE + max(0, int(h["parts"] or 0) - 1))
    least = min((h["level"] for h in heads), default=BASE)
    for h in heads:
        h["level"] += BASE - least
    plain = [h for h in heads if h["style"] in ANCHOR_STYLES and (h["parts"] or 1) == 1 and not h["author"]]
    if _anchored(plain):
        for h in plain:
            h["level"] = BASE
    before = BASE - 1
    for h in heads:
        h["level"] = BASE if set(h["labels"]) & set(TOP_LEVEL) else min(h["level"], before + 1)
        before = h["level"]


def _number_hypotheses(heads: list[dict]) -> None:
    """``仮説 n`` without a number of its own gets the nearest number before it and its place behind that."""
    base, n = None, 0
    for h in heads:
        if h["hypothesis"] and not h["prefix"]:
            n += 1
            h["prefix"] = f"{base.rstrip('.．')}.{n}" if base else str(n)
        elif h["prefix"]:
            base, n = h["prefix"], 0


def _closed(labels: set[str]) -> set[str]:
    return labels | {structure.PARENTS[x] for x in labels if x in structure.PARENTS}


def _primary(labels: set[str]) -> str | None:
    order = lambda c: (c not in structure.PARENTS.values(), structure.PRIORITY[c])
    return min(labels, key=order, default=None)


def _outline(rows: list[dict], skipped: frozenset[str]) -> list[dict]:
    """The sections of one document from its blocks in order."""
    at = 0
    for r in rows:
        r["start"], at = at, at + len(r["body"]) + len(GAP)
    length = max(0, at - len(GAP))
    titles = []
    for r in rows:  # a document's first header of level 1, and one of level 2 right behind it, name the document
        if r["kind"] != "header" or len(titles) == 2 or int(r["level"]) != len(titles) + 1 or len(r["labels"]) or r["prefix"]:
            break
        titles.append(r)
    if len(titles) == 2 and not any(r["is_heading"] and r["kind"] == "header" and int(r["level"]) > 2 for r in rows):
        titles.pop()  # the only headers of the text are of level 2: that one is a section
    named = {id(r) for r in titles}
    heads = [r for r in rows if r["is_heading"] and id(r) not in named]
    _number_hypotheses(heads)
    _levels(heads)
    stack, top = [], {"own": set(), "body": [], "up": None}
    for h in heads:
        h |= {"own": set(h["labels"]), "given": set(), "body_parts": [], "stop": length}
        while stack and stack[-1]["level"] >= h["level"]:
            stack.pop()["stop"] = h["start"]
        h["up"] = stack[-1] if stack else None
        if h["up"]:
            h["up"]["given"] |= h["own"] & set(structure.PROPAGATED)
        stack.append(h)
    for h in heads:
        h["all"] = _closed(h["own"] | h["given"])
        main, up = _primary(_closed(h["own"])), h["up"]
        h["path"] = [*(up["path"] if up else []), h["body"]]
        h["category"] = None if up and main == up["effective"] else main
        h["effective"] = h["category"] or (up["effective"] if up else None)
        h["owner"] = h if h["category"] or not up else up["owner"]
        h["left_out"] = bool(h["effective"] in skipped)
        h["cut"] = False
        if h["left_out"]:  # what follows inside its ancestors' own text goes too
            while up:
                up["cut"], up = True, up["up"]
        elif h["owner"] is not h and h["owner"] and h["owner"]["cut"]:
            h["owner"] = None
    now, head = None, {id(h): h for h in heads}
    for r in rows:
        if id(r) in head:
            now = r
        elif id(r) not in named:
            owner = now["owner"] if now else top
            if owner is not None:
                owner["body_parts" if now else "body"].append(r["body"])
    out = [{"idx": int(t["idx"]), "level": 1, "heading": t["body"], "number": None, "labels": [n], "category": n, "parent": None, "path": [t["body"]], "start": t["start"], "stop": length, "body": "", "shown": n not in skipped} for t, n in zip(titles, ("title", "subtitle"))]
    if top["body"]:
        out.append({"idx": -1, "level": 1, "heading": None, "number": None, "labels": ["unknown"], "category": "unknown", "parent": None, "path": [], "start": 0, "stop": heads[0]["start"] if heads else length, "body": GAP.join(top["body"]), "shown": "unknown" not in skipped})
    for h in heads:
        out.append({"idx": int(h["idx"]), "level": h["level"], "heading": h["body"], "number": h["prefix"], "labels": sorted(h["all"]), "category": h["category"], "parent": int(h["up"]["idx"]) if h["up"] else None, "path": h["path"], "start": h["start"], "stop": h["stop"], "body": GAP.join(h["body_parts"]), "shown": not h["left_out"] and (h["owner"] is h)})
    return out


def nodes(docs: DataFrame, key: str = "basename", text: str = "text", skipped: Sequence[str] = EXCLUDED) -> DataFrame:
    """key, idx (the heading's block), level, heading, number, labels, category, parent, path, start, stop, body, shown.

    Labels are the heading's, the propagated ones of its children, and parent classes. ``category`` is the first of the
    heading's own, null where it repeats the one above. A section's body has its blocks and those of headings below it
    without a category, up to the first section below it whose category is in ``skipped``. Text before any heading has idx
    -1 and the category unknown. ``shown`` is false for skipped sections and those whose text went to one above.

    ``key`` must be unique; a null key or text gives no sections.
    """
    found = headings(corpus.markdown_blocks(docs.where(F.col(key).isNotNull()), key, text))
    blocks = [c for c in found.columns if c != key]
    whole = found.groupBy(key).agg(F.collect_list(F.struct(*blocks)).alias("__blocks")).select(key, "__blocks")
    left_out = frozenset(skipped)
    columns = ["idx", "level", "heading", "number", "labels", "category", "parent", "path", "start", "stop", "body", "shown"]
    kinds = pa.struct([("idx", pa.int32()), ("level", pa.int32()), ("heading", pa.string()), ("number", pa.string()), ("labels", pa.list_(pa.string())), ("category", pa.string()), ("parent", pa.int32()), ("path", pa.list_(pa.string())), ("start", pa.int64()), ("stop", pa.int64()), ("body", pa.string()), ("shown", pa.bool_())])

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                few = batch.slice(at, SLICE)
                at_row, out = [], []
                for i, rows in enumerate(few.column(1).to_pylist()):
                    rows.sort(key=lambda r: r["idx"])
                    for r in rows:
                        r["labels"] = r["labels"] or []
                    mine = _outline(rows, left_out)
                    at_row += [i] * len(mine)
                    out += mine
                cols = pa.array([{c: r[c] for c in columns} for r in out], kinds).flatten()
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(at_row, pa.int32())), *cols], names=[key, *columns])

    return whole.mapInArrow(sections, f"`{key}` {docs.schema[key].dataType.simpleString()}, {NODE}")


def section_texts(docs: DataFrame, key: str = "basename", text: str = "text", skipped: Sequence[str] = EXCLUDED) -> DataFrame:
    """The shown sections with mostly CJK text: key, section, heading, number, path, parent, text; uncategorised ones are ``unknown``."""
    rows = nodes(docs, key, text, skipped).where("shown").where(mostly_cjk(F.col("body")))
    return rows.select(key, F.coalesce("category", F.lit("unknown")).alias("section"), "heading", "number", "path", "parent", strip(F.col("body")).alias("text"))
