"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text's lines are its paragraphs.  A paragraph ends a section where its hash says so (one in
``SECTION`` on average), and is cut into pieces after words whose hash says so (one in ``PIECE``), or
after ``LONGEST`` words, so an edit moves borders only near itself.  A node's hash covers its children's hashes; equal texts have equal roots,
and differing branches lead to the edit.

The fingerprint is text: root hash (SHA-256 over the sections' nodes), then sections joined by ``/``; a section is its node
(128 bit, over its paragraphs' nodes, and these over the whole hashes of their pieces), ``:`` and its
paragraphs joined by ``.``; a paragraph is its pieces' hashes, cut to 6 hex digits each, which serve the likeness only.  The
likeness of two fingerprints is the share of pieces they have in common (a multiset Dice coefficient); equal
roots give 1, and branches with equal nodes are taken whole.

Defined results: a null text has the empty text's fingerprint.  Two texts without pieces are alike (1).  Every row has a
row, repeated ones and those with a null key too (which come last); rows with equal keys follow each other in
the order of their texts; a single row follows itself; an empty table gives none.  Columns other than key and text are not
read, so clashing names do not matter; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, settle, shuffle_width, slices, trim

SECTION = 8
PIECE = 6
LEAF = 6
LONGEST = 16
#: Words whose cuts a worker keeps, about 120 bytes each.
KEPT = 100_000
_CUTS: dict[str, bool] = {}
_leaf = xxhash.xxh3_128_hexdigest


def pieces(paragraph: str) -> list[str]:
    """Hashes (128 bit) of a paragraph's pieces, in order; a piece has ``LONGEST`` words at most."""
    out, words, at, cuts = [], paragraph.split(" "), 0, _CUTS
    if len(cuts) > KEPT:
        cuts.clear()
    for i, w in enumerate(words, 1):
        cut = cuts.get(w)
        if cut is None:
            cut = xxhash.xxh3_64_intdigest(w, 1) % PIECE == 0
            if len(w) < 64:
                cuts[w] = cut
        if cut or i - at == LONGEST:
            out.append(_leaf(" ".join(words[at:i])))
            at = i
    if at < len(words):
        out.append(_leaf(" ".join(words[at:])))
    return out


Paragraph = tuple[str, bool, str]


def paragraphs(text: str, known: dict[str, Paragraph] | None = None) -> dict[str, Paragraph]:
    """For each paragraph the short hashes of its pieces, joined, whether it ends a section, and its node; ``known`` holds some already."""
    out: dict[str, Paragraph] = {}
    for line in text.split("\n"):
        if line not in out:
            out[line] = (known or {}).get(line) or _paragraph(line)
    return out


def _paragraph(line: str) -> Paragraph:
    own = pieces(line)
    return "".join([p[:LEAF] for p in own]), xxhash.xxh3_64_intdigest(line, 2) % SECTION == 0, _node(own)


def fingerprint(text: str | None, known: dict[str, Paragraph] | None = None) -> str:
    if not text:
        return _root([])
    mine, sections, now = paragraphs(text, known), [], []
    for line in text.split("\n"):
        now.append(mine[line])
        if now[-1][1]:
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    nodes = [_node([p[2] for p in s]) for s in sections]
    return "/".join([_root(nodes), *(f"{n}:{'.'.join([p[0] for p in s])}" for n, s in zip(nodes, sections))])


def _node(children: list[str]) -> str:
    """Hash of a node's children, which covers all text below it."""
    return xxhash.xxh3_128_hexdigest("/".join(children))


def _root(nodes: list[str]) -> str:
    return hashlib.sha256("/".join(nodes).encode()).hexdigest()


def _sections(fp: str) -> list[tuple[str, str]]:
    return [tuple(s.split(":", 1)) for s in fp.split("/")[1:]]


def leaves(paragraphs: str) -> list[str]:
    return [p[i : i + LEAF] for p in paragraphs.split(".") for i in range(0, len(p), LEAF)]


def likeness(a: str, b: str) -> float:
    """Share of common pieces, from 0 to 1."""
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    x, y = _sections(a), _sections(b)
    same = Counter(h for h, _ in x) & Counter(h for h, _ in y)
    common, total, rest = 0, 0, []
    for side in (x, y):
        left, mine = Counter(same), Counter()
        for h, body in side:
            n = leaves(body)
            total += len(n)
            if left[h]:  # an equal branch: its pieces are common as a whole
                left[h] -= 1
                common += len(n)
            else:
                mine.update(n)
        rest.append(mine)
    common += 2 * (rest[0] & rest[1]).total()
    return common / total if total else 1.0


def branches(a: str, b: str) -> tuple[list[int], list[int]]:
    """Places of the sections of either fingerprint that the other lacks: where the edits are."""
    x, y = _sections(a), _sections(b)
    one, two = {h for h, _ in x}, {h for h, _ in y}
    return [i for i, (h, _) in enumerate(x) if h not in two], [i for i, (h, _) in enumerate(y) if h not in one]


def edited(text: str, following: str) -> str:
    """The last third (floor) of ``text`` replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "fingerprint"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, which takes its end from the next document by falling key.

    Keys are cut into ranges; a task reads its range in order, so each text moves once.  The first
    document of a range also goes to the range before it, as the last one's follower.  Equal keys follow
    each other in the order of their texts; null keys come last.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark) * 2
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cuts = sorted({float(c) for c in rows.approxQuantile("k", [i / width for i in range(1, width)], 0.2 / width) if c is not None}, reverse=True)
    low = -(1 << 63)
    order = F.coalesce("k", F.lit(low))
    part = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(int(c)) for c in cuts])
        part = F.size(F.filter(bounds, lambda c: c > order))
    ranged = rows.withColumn("part", part)
    heads = settle(ranged.groupBy("part").agg(F.max(order).alias("k")))
    known = sorted((r.part, r.k) for r in heads.collect())  # one row for each range
    if not known:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {k: (known[i - 1][0] if i else known[-1][0]) for i, (_, k) in enumerate(known)}
    again = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    n = len(known)
    # A follower's copy has rank 1; the first document follows the last one, so it also goes to the last range.
    copies = F.when(F.map_contains_key(again, order), F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("r")), F.struct(again[order].alias("p"), F.lit(1).alias("r"))))
    copies = copies.otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("r"))))
    dealt = ranged.withColumn("c", F.explode(copies)).select(F.col("c.p").alias("p"), F.col("c.r").alias("r"), "k", "t")
    dealt = dealt.repartition(max(n, 1), "p").sortWithinPartitions("p", "r", F.col("k").desc_nulls_last(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (p, r, k, text, fingerprint), waits for its follower
        for b in slices(batches, 64):
            out = []
            for p, r, k, t in zip(*(c.to_pylist() for c in b.columns)):
                lines = paragraphs(t)
                f = fingerprint(t, lines)
                if held and held[1] == 0 and held[0] == p:
                    out.append(row(held, t, f, lines))
                held = (p, r, k, t, f, lines)
            if out:
                yield pa.RecordBatch.from_pylist(out, OUT)
        _CUTS.clear()
        trim()

    def row(held: tuple, t: str, f: str, lines: dict) -> dict:
        _, _, k, own, mine, known = held
        e = edited(own, t)
        other = fingerprint(e, known | lines) if e != own else mine
        return {"doc_id": k, "n_chars": len(own), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": mine, "edited_fingerprint": other, "near_edited": likeness(mine, other), "near_next": likeness(mine, f)}

    return map_arrow(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
