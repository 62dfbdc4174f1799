"""Main text of HTML pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by the path of block elements that leads to them, and its
text blocks with their path.  A token's occurrence vector holds its count on each page of the host; a
sum over pages (XOR of hashes of page and count) stands for the vector, so vectors of any length are
compared by one grouped aggregate over all pages, with partial sums before the shuffle.

Tokens of a host with the same vector that are on at least ``SUPPORT`` of its pages form an equivalence class.  A
class is valid if its element tokens nest: each path hangs below the template or below another of the class.
Valid classes nest into the template; what they leave open are its slots.  The main text is what fills the
slots below one element of the template: going down from the root, the one that keeps ``KEEPS`` of the text of
all slots (links aside), as long as no slot with a heading is left behind.  Only where no element keeps so
much do the names of elements (menus, notices and other parts) help to weigh slots.  Texts of a class are
template text and no part of a slot; inside the main slot, parts with such names are left out.

Hosts of fewer than ``LEAST_PAGES`` pages cannot tell slots from template text.  They take the element from all
pages, of any host, whose outer elements are the same.  Hosts' templates are joined to the pages by host
(Spark broadcasts the table only where it is small, and splits a host that holds a large share of the pages).

Blocks are the texts between the borders of block elements; white space in a block becomes one space.

Defined results: a null or empty page has the empty text.  A page without a host (no URL) shares one
template with the others without.  Pages that the template does not fit give every block outside parts with
names of menus, notices and the like, or every block where nothing else is left.  Every row gives a row, repeated ones
and those with a null key too, and an empty table none; columns other than page_id, url and html are not read.  Elements that are
nested deeper than ``DEEPEST`` share a path.  Unclosed scripts and styles go on to the end of the page; other
elements without text of their own (svg, template and such) are passed over if they are not closed.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, settle, slices, trim

SUPPORT = 0.5
#: Pages below which a host's own pages do not tell slots from template text.
LEAST_PAGES = 4
#: Steps of a path.
DEEPEST = 48
#: Steps of the paths that make a page's outer elements.
OUTER = 3
KEEPS = 0.8
#: Share of a host's pages from which a text below a plain element is template text.
FIXED_TEXT = 0.9

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg iframe textarea title canvas select".split())
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset("math mi mn mo mrow msup msub mfrac object noscript a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
SIDE = frozenset("nav footer aside form button dialog menu".split())
SIDE_NAME = re.compile(r"(?:^|[-_\s])(ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|nav\w*|menu|breadcrumbs?|sidebar|side|footer|masthead|comments?|replies|respond|disqus|share|social|related|recommended|newsletter|subscribe|popup|modal|widget|toolbar|pagination|skip)(?:$|[-_\s\d])", re.I)
MAIN = frozenset(("article", "main"))
ROWS = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 ul ol dl table tbody thead blockquote pre".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>?", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Block:
    __slots__ = ("path", "marks", "text", "linked")

    def __init__(self, path: str, marks: int, text: str, linked: int) -> None:
        self.path, self.marks, self.text, self.linked = path, marks, text, linked

    def side(self, depth: int = 0) -> bool:
        """Whether an element deeper than ``depth`` is named like a side part."""
        return self.marks > depth


def _closed(page: str, name: str, at: int) -> int:
    """End of the element that has just opened, others of its name inside it counted; -1 if it is not closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if name in TO_THE_END or m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return -1


def parse(page: str | None) -> tuple[list[Block], dict[str, int]]:
    """Text blocks in page order, and how often each element path opens."""
    page = page or ""
    blocks: list[Block] = []
    opened: dict[str, int] = {"": 1}
    # Of each open element: name, path, steps of the path, deepest step with a side part's name, whether main text may be meant.
    stack: list[tuple[str, str, int, int, bool]] = [("", "", 0, 0, False)]
    names: dict[str, int] = defaultdict(int)
    lost: set[str] = set()
    parts: list[str] = []
    linked = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1][1], stack[-1][3], text, linked))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        for s in stack[i:]:
            names[s[0]] -= 1
        del stack[i:]

    def cut_to(name: str, stops: tuple[str, ...]) -> None:
        if names[name] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    return close(i)
                if stack[i][0] in stops:
                    return

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if anchors:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                anchors = 0 if closing else 1
        elif name in RAW:
            if not closing and not m[3].endswith("/") and name not in lost:
                end = _closed(page, name, at)
                if end >= 0:
                    at = end
                elif name in TO_THE_END:
                    at = n
                else:
                    lost.add(name)
                parts.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        elif closing:
            flush()
            anchors = 0
            if names[name] > 0:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                close(i)
        else:
            flush()
            anchors = 0
            if name in CLOSES_P:
                cut_to("p", ("td", "th", "li", "div", "article", "section", "main", "blockquote", "body"))
            if name in ITEMS:
                cut_to(name, ITEMS[name])
            if name in ("body", "html") and names[name] > 0:
                continue
            own = " ".join(x or y or z for x, y, z in NAMES.findall(m[3])) if m[3] else ""
            _, path, steps, marks, in_main = stack[-1]
            steps += 1
            if steps <= DEEPEST:
                path = f"{path}/{name}" + (f".{own.split()[0].replace('/', '')}" if own.split() else "")
            if name in SIDE or name == "head" or (name == "header" and not in_main) or (own and name not in ("html", "body") and SIDE_NAME.search(own)):
                marks = min(steps, DEEPEST)
            stack.append((name, path, steps, marks, in_main or name in MAIN))
            names[name] += 1
            opened[path] = opened.get(path, 0) + 1
    flush()
    return blocks, opened


def _hash(*x: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, x)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _text_token(b: Block) -> str:
    return f"{b.path}\x1f{_hash(b.text)}"


TOKENS = "host string, token string, vec bigint, pages bigint, chars bigint, plain bigint"
LAYOUT = "\x1d"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums by host and token: vector, pages, characters of slot text below an element, and those outside side parts.

    A page's elements are counted for its outer elements as well, in place of the host, and ``LAYOUT`` tells a host's outer elements.
    """
    sums: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, t, *v) for (h, t), v in sums.items()]
        sums.clear()
        cols = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), *[pa.int64()] * 4))], names=["host", "token", "vec", "pages", "chars", "plain"])

    def add(host: str, token: str, vec: int, chars: int, plain: int) -> None:
        s = sums.setdefault((host, token), [0, 0, 0, 0])
        s[0] ^= vec
        s[1] += 1
        s[2] += chars
        s[3] += plain

    for b in slices(batches):
        for key, host, page in zip(*(c.to_pylist() for c in b.columns)):
            blocks, opened = parse(page)
            below: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            texts: dict[str, int] = defaultdict(int)
            own: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for x in blocks:
                texts[_text_token(x)] += 1
                size = max(0, len(x.text) - x.linked)
                own[x.path][0] += size
                own[x.path][1] += 0 if x.side() else size
            for p, (size, plain) in own.items():
                while True:
                    below[p][0] += size
                    below[p][1] += plain
                    if not p:
                        break
                    p = p[: p.rfind("/")]
            outer = LAYOUT + str(_hash(*sorted(p for p in opened if p.count("/") <= OUTER)))
            for t, n in opened.items():
                vec = _hash(key, n)
                add(host, t, vec, *below.get(t, (0, 0)))
                add(outer, t, vec, *below.get(t, (0, 0)))
            for t, n in texts.items():
                add(host, t, _hash(key, n), 0, 0)
            add(host, LAYOUT, 0, 0, 0)
            sums[host, LAYOUT][0] = int(outer[1:])
        if len(sums) > 100_000:
            yield out()
    yield out()
    trim()


def deduce(tokens: list[tuple[str, int, int, int, int]]) -> tuple[str, list[str]]:
    """(path of the element that holds the main text, template texts) from a host's tokens: (token, vec, pages, chars, plain)."""
    by = {t: (v, n, c, w) for t, v, n, c, w in tokens}
    if "" not in by:
        return "", []
    pages = by[""][1]
    classes: dict[int, list[str]] = defaultdict(list)
    for t, (v, n, _, _) in by.items():
        if n >= SUPPORT * pages and not t.startswith(LAYOUT):
            classes[v].append(t)
    template, texts = {""}, []
    for members in sorted(classes.values(), key=lambda c: (-by[c[0]][1], min(map(len, c)))):
        paths = {t for t in members if "\x1f" not in t}
        # Valid if every element of the class hangs below the template or below another of the class.
        if all(p == "" or (q := p[: p.rfind("/")]) in template or q in paths for p in paths):
            template |= paths
            texts += [t for t in members if "\x1f" in t]
    fixed = sorted(t for t in texts if by[t][1] >= FIXED_TEXT * pages)
    said = {t.partition("\x1f")[0] for t in fixed}
    children: dict[str, list[str]] = defaultdict(list)
    for p in template - {""}:
        children[p[: p.rfind("/")]].append(p)
    heads = [p for p in template if _name(p) in ("h1", "h2") and p not in said and by[p][3]]
    path = ""
    while True:
        keeps = []
        for which in (2, 3):  # all slots; where they do not decide, those outside side parts
            keeps = keeps or [p for p in children[path] if by[path][which] and by[p][which] >= KEEPS * by[path][which]]
        if not keeps or _name(path) in MAIN:
            break
        best = max(keeps, key=lambda p: (by[p][3], by[p][2], p))
        if any(_below(h, path) and not _below(h, best) for h in heads) or _name(best) in ROWS:
            break
        path = best
    return path, [t for t in fixed if _below(t.partition("\x1f")[0], path)]


def _name(path: str) -> str:
    return path[path.rfind("/") + 1 :].split(".")[0]


def _below(path: str, other: str) -> bool:
    return path == other or path.startswith(other + "/")


def templates(pages: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``fixed`` (template texts) from all pages (page_id, host, html)."""
    sums = map_arrow(pages.select("page_id", "host", "html"), _tokens, TOKENS)
    outer = F.col("token") == LAYOUT
    sums = sums.groupBy("host", "token").agg(F.when(F.first(outer), F.max("vec")).otherwise(F.bit_xor("vec")).alias("vec"), *[F.sum(c).alias(c) for c in ("pages", "chars", "plain")])
    sums = settle(sums.where("pages > 1 or token = '' or token not like '%\x1f%'"))
    whole = sums.where("token = ''").select("host", F.col("pages").alias("all"))
    often = sums.where(~outer).join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("all"))  # at most tokens-per-page / SUPPORT for a host
    listed = often.groupBy("host").agg(F.max("all").alias("all"), F.collect_list(F.struct("token", "vec", "pages", "chars", "plain")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [deduce([tuple(t[c] for c in ("token", "vec", "pages", "chars", "plain")) for t in ts]) for ts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p for p, _ in got], pa.string()), pa.array([f for _, f in got], pa.list_(pa.string()))], names=["host", "all", "path", "fixed"])

    made = settle(map_arrow(listed, run, "host string, `all` long, path string, fixed array<string>"))
    shared = made.where(F.col("host").startswith(LAYOUT)).select(F.substring("host", 2, 30).cast("long").alias("vec"), F.col("path").alias("lent"))
    few = made.where((F.col("all") < LEAST_PAGES) & ~F.col("host").startswith(LAYOUT)).join(sums.where(outer).select("host", "vec"), "host").join(shared, "vec", "left")
    many = made.where((F.col("all") >= LEAST_PAGES) & ~F.col("host").startswith(LAYOUT)).select("host", "path", "fixed")
    return settle(many.union(few.select("host", "lent", F.expr("cast(array() as array<string>)"))))  # written, so that its size is known


def main_text(page: str | None, path: str | None, fixed: list[str] | None) -> str:
    blocks, opened = parse(page)
    fixed_set, depth = set(fixed or ()), 0
    own = [b for b in blocks if not b.side()]
    if path and path in opened:
        depth = path.count("/")
        inside = [b for b in blocks if not b.side(depth) and _below(b.path, path)]
        own = inside or own
    kept = [b.text for b in own if not fixed_set or _text_token(b) not in fixed_set]
    return "\n".join(kept or [b.text for b in own or blocks if _name(b.path) != "head"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    joined = rows.join(templates(rows), "host", "left").select("page_id", "url", "html", "path", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h, p, f) for h, p, f in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long")
