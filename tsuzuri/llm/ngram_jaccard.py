"""Exact Jaccard self-join on word shingles, with set-relation skipping.

A document's set holds the hashes (64 bit) of its distinct 5-word shingles.  Two sets link when
``100 * intersection >= 80 * union``.  The steps, each distributed and exact:

1. One pass over the texts gives each set's digest and size (equal sets form one class) and its prefix
   under a global order of shingles; two similar sets share a shingle of their prefixes.  The order
   puts shingles that a sample of documents shows to be common last.  The sample only chooses among
   valid orders; the result is the same under any order.
2. Index lists (the sets that hold a shingle in their prefix) are read in the order of positions and cut
   into blocks.  At the first shingle that two sets share, their overlap is at most what is left of either
   from that position on; so a block whose least position and sizes cannot reach the overlap that
   another block's sets need is skipped, unseen.  A shingle that the sample shows in very many sets has
   several lists, so that no task reads them all.
3. A list of up to ``SHORT`` sets gives its possible pairs.  A longer one is answered by set relations: its sets
   are compared with the ``PIVOTS`` sets of the lowest positions (those with the fewest rare shingles, so
   the nearest to what the list shares).  The verified links give components; then pairs of different
   components are looked for in pairs of blocks of the list, a task each, again skipped by size and position.
4. Linked sets are of one component, so the links that are still missing join two sets of long lists and of
   one component.  These are dealt into blocks of like size; in each pair of blocks that can link, answers are
   derived from one set's: a set is held as its difference from that set, which decides most pairs by its
   size alone, and the others by what two differences share.  This completes the links and counts.
5. Candidate pairs of steps 2 and 3 are first compared on the shingles of one quarter of the hash range: if these alone
   differ by more than linked sets can, the pair is out.  The others are verified on the whole sets,
   and links give components.

Shingles and classes are told apart by 64-bit hashes, classes by their size as well.

Defined results: texts with fewer than five words have their whole word sequence as the only shingle;
null texts and texts without words have ``n_shingles`` 0 and link with nothing.  ``n_links`` counts the
other rows that a row links with, exact copies among them.  Repeated rows are
copies.  A null key has a null component.  Pairs at exactly 0.8 link.  An empty table gives no rows.  Columns other
than key and text are not read, so clashing names do not matter; ``first_of_each`` keeps them all, and of repeated
keys the row with the smallest text, then the smallest other columns.  Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tsuzuri.llm.common import map_arrow, settle, shuffle_width, slices, spare, trim
from tsuzuri.llm.components import components

WORDS = 5
#: Share of documents whose shingles are counted to find common ones: one in SAMPLE.
SAMPLE = 64
#: Most common shingles that are broadcast (16 bytes each).
COMMON = 300_000
#: Lists up to this length give all their pairs at once; longer ones are answered by pivots, components and blocks.
SHORT = 24
PIVOTS = 8
#: Sets of a position block in a list.
STEP = 4
#: Estimated sets of a shingle beyond which it has several lists.
LIST = 4096
#: 64-bit words of a Bloom filter: 8 bits for each id within these bounds; a full filter only filters less.
BLOOM_WORDS = 1 << 12, 1 << 22
#: Shingles below this hash are a set's sketch.
QUARTER = -(1 << 62)
#: Sets, and shingles, of a block on average; columns of its matrix at a time.
BLOCK = 256
BLOCK_TOKENS = 500_000
COLUMNS = 4096
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes (int64)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    else:
        m = n - WORDS + 1
        out = h[:m] * ODD[0]
        for i in range(1, WORDS):
            out += h[i : i + m] * ODD[i]
        h = _mixed(out)
    return np.unique(h.view(np.int64))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes: 9 * overlap >= 4 * (a + b)."""
    return (4 * (a + b) + 8) // 9


def possible(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Size filter and position filter at the first shared shingle (0-based positions)."""
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (np.minimum(a - pa_, b - pb) >= needed(a, b))


class Order:
    """Global order: shingles that are not common by hash, then common ones by count in the sample and hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]
        lists = self.counts * SAMPLE // LIST
        self.hot, self.lists = self.tokens[lists > 1], lists[lists > 1]

    def salts(self, tokens: np.ndarray, ent: int) -> np.ndarray:
        """0, or for shingles of very many sets which of their lists the set ``ent`` goes to."""
        out = np.zeros(len(tokens), np.int32)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, tokens), len(self.hot) - 1)
            found = self.hot[at] == tokens
            out[found] = 1 + ent % self.lists[at[found]]
        return out

    def prefix(self, s: np.ndarray) -> np.ndarray:
        k = prefix_length(len(s))
        if len(self.tokens) == 0:
            return s[:k]
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        rank = np.where(self.tokens[at] == s, self.counts[at], 0)
        if not rank.any():
            return s[:k]
        rare = s[rank == 0]
        if len(rare) >= k:
            return rare[:k]
        common = rank > 0
        rest = s[common][np.lexsort((s[common], rank[common]))]
        return np.concatenate([rare, rest[: k - len(rare)]])


def _common(docs: DataFrame, text: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            if sets:
                tokens, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n)], names=["token", "n"])

    some = docs.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(SAMPLE)) == 0).select(text)
    seen = map_arrow(some, count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 3")
    top = seen.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    return top["token"].to_numpy(), top["n"].to_numpy()


def _entries(docs: DataFrame, text: str, key: str, order: Order) -> DataFrame:
    """Rows (token, salt, ent, size, pos) of prefixes, and for each document one with its key as token and pos -1.

    A shingle that the sample shows in very many sets has several lists, told apart by ``salt`` from 1 on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)  # COMMON entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for b in slices(batches, 256):
            keys, own, tokens, salts, ents, sizes, places = b.column(0), [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t)
                e = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                own.append((e, len(s)))
                if len(s) and (e, len(s)) not in seen:
                    seen.add((e, len(s)))
                    p = order.prefix(s)
                    tokens.append(p)
                    salts.append(order.salts(p, e))
                    ents.append(np.full(len(p), e, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                    places.append(np.arange(len(p), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(np.zeros(len(own), np.int32)), pa.array([e for e, _ in own], pa.int64()), pa.array([n for _, n in own], pa.int32()), pa.array(np.full(len(own), -1, np.int32))], names=names)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, salts, ents, sizes, places)], names=names)
        trim()

    names = ["token", "salt", "ent", "size", "pos"]
    return map_arrow(docs.select(key, text), run, "token long, salt int, ent long, size int, pos int")


PAIR, LONG, MEMBER = 0, 1, 2
FOUND = "kind int, a long, an int, b long, bn int"


@lru_cache(maxsize=64)
def _corners(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, k)


def reachable(low: np.ndarray, high: np.ndarray, pos: np.ndarray, low2: np.ndarray, high2: np.ndarray, pos2: np.ndarray) -> np.ndarray:
    """Whether blocks with these least and largest sizes and least positions can hold a possible pair."""
    return (5 * high >= 4 * low2) & (5 * high2 >= 4 * low) & (5 * high - 9 * pos >= 4 * low2) & (5 * high2 - 9 * pos2 >= 4 * low)


class _Lists:
    """Reads entries sorted by (token, salt, pos, size, ent) and gives candidate pairs; ``feed`` takes arrays of any length.

    A list is cut into blocks of ``STEP`` entries; as positions rise, blocks that cannot reach the overlap which another
    block's sets need are skipped by their least position and sizes, unseen.
    """

    def __init__(self) -> None:
        self.rest: tuple[np.ndarray, ...] | None = None
        self.list, self.pivots = None, None  # of a list that is longer than one feed
        self.out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def feed(self, token: np.ndarray, salt: np.ndarray, ent: np.ndarray, size: np.ndarray, pos: np.ndarray, end: bool = False) -> None:
        if self.rest is not None:
            token, salt, ent, size, pos = (np.concatenate(x) for x in zip(self.rest, (token, salt, ent, size, pos)))
        self.rest = None
        if not len(token):
            return
        if not end:
            others = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            cut = int(others[-1]) + 1 if len(others) else 0
            if len(token) - cut <= 4096:
                self.rest = tuple(x[cut:] for x in (token, salt, ent, size, pos))
                token, salt, ent, size, pos = (x[:cut] for x in (token, salt, ent, size, pos))
                if not cut:
                    return
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        keep = new.copy()  # one entry for each set: classes that several tasks saw
        keep[1:] |= (ent[1:] != ent[:-1]) | (size[1:] != size[:-1])
        token, salt, ent, size, pos, new = (x[keep] for x in (token, salt, ent, size, pos, new))
        starts = np.flatnonzero(new)
        lens = np.diff(np.r_[starts, len(token)])
        if self.pivots is not None and (token[0], salt[0]) == self.list:
            self._long(token[0], ent[: lens[0]], size[: lens[0]], pos[: lens[0]], self.pivots)
            starts, lens = starts[1:], lens[1:]
        if len(starts):
            self.pivots = None
        hot = (lens > SHORT) | (salt[starts] > 0)
        for n in np.unique(lens[(lens > 1) & ~hot]):
            first = starts[(lens == n) & ~hot]
            if n <= STEP:
                i, j = _corners(int(n), 1)
                self._possible(ent, size, pos, (first[:, None] + i).ravel(), (first[:, None] + j).ravel())
            else:
                self._in_blocks(ent, size, pos, first, int(n))
        for s, n in zip(starts[hot], lens[hot]):
            part = slice(s, s + n)
            self.pivots = tuple(x[s : s + min(n, PIVOTS)] for x in (ent, size, pos))
            self.list = token[s], salt[s]
            self._long(token[s], ent[part], size[part], pos[part], self.pivots)
        if len(starts) and self.list != (token[-1], salt[-1]):
            self.pivots = None

    def _in_blocks(self, ent: np.ndarray, size: np.ndarray, pos: np.ndarray, first: np.ndarray, n: int) -> None:
        """Pairs of lists of n entries that begin at ``first``, from the pairs of blocks that are not skipped."""
        cuts = np.arange(0, n, STEP)
        inside = first[:, None] + np.minimum(cuts[:, None] + np.arange(STEP), n - 1).ravel()
        sizes = size[inside].reshape(len(first), len(cuts), STEP)
        low, high, least = sizes.min(2), sizes.max(2), pos[first[:, None] + cuts]
        i, j = _corners(len(cuts), 0)
        lists, pair = np.nonzero(reachable(low[:, i], high[:, i], least[:, i], low[:, j], high[:, j], least[:, j]))
        r, c = np.divmod(np.arange(STEP * STEP), STEP)
        x, y = cuts[i[pair]][:, None] + r, cuts[j[pair]][:, None] + c
        ok = (x < y) & (y < n)
        base = np.broadcast_to(first[lists][:, None], x.shape)[ok]
        self._possible(ent, size, pos, base + x[ok], base + y[ok])

    def _possible(self, ent: np.ndarray, size: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        ok = possible(size[x], pos[x], size[y], pos[y])
        self._pairs(ent[x[ok]], size[x[ok]], ent[y[ok]], size[y[ok]])

    def _long(self, token: np.int64, ent: np.ndarray, size: np.ndarray, pos: np.ndarray, pivots: tuple[np.ndarray, ...]) -> None:
        cuts = np.arange(0, len(ent), 64 * STEP)
        low, high = np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
        for e, n, p in zip(*pivots):
            n, p = np.int64(n), np.int64(p)
            open_ = np.repeat(reachable(n, n, p, low, high, pos[cuts]), np.diff(np.r_[cuts, len(ent)]))
            at = np.flatnonzero(open_)
            at = at[possible(n, p, size[at], pos[at]) & ((ent[at] != e) | (size[at] != n))]
            self._pairs(np.full(len(at), e), np.full(len(at), n, np.int32), ent[at], size[at])
        self.out.append((LONG, np.full(len(ent), token, np.int64), pos, ent, size))

    def _pairs(self, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> None:
        if len(a):
            swap = (a > b) | ((a == b) & (an > bn))
            a, b, an, bn = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, bn, an), np.where(swap, an, bn)
            keep = (a != b) | (an != bn)
            self.out.append((PAIR, a[keep], an[keep], b[keep], bn[keep]))

    def taken(self) -> Iterator[pa.RecordBatch]:
        pairs = [o[1:] for o in self.out if o[0] == PAIR]
        longs = [o[1:] for o in self.out if o[0] == LONG]
        self.out = []
        if pairs:
            x = np.stack([np.concatenate([p[i] for p in pairs]).astype(np.int64) for i in range(4)], 1)
            yield _found(PAIR, *np.unique(x, axis=0).T)
        if longs:
            yield _found(LONG, *(np.concatenate([p[i] for p in longs]) for i in range(4)))


def _found(kind: int, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(x), t) for x, t in zip((a.astype(np.int64), an.astype(np.int32), b.astype(np.int64), bn.astype(np.int32)), (pa.int64(), pa.int32(), pa.int64(), pa.int32())))]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "a", "an", "b", "bn"])


def _read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = _Lists()
    for b in batches:
        pos = b.column(4).to_numpy()
        own = pos < 0
        if own.any():
            m = b.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.num_rows, MEMBER, np.int32)), m.column(0), m.column(3), m.column(2), m.column(3)], names=["kind", "a", "an", "b", "bn"])
            b = b.filter(pa.array(~own))
        if b.num_rows:
            lists.feed(*(b.column(i).to_numpy() for i in range(5)))
            yield from lists.taken()
    empty = np.empty(0, np.int64)
    few = empty.astype(np.int32)
    lists.feed(empty, few, empty, few, few, end=True)
    yield from lists.taken()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs of different components from pairs of blocks, which come sorted: (task, side, rep, size, pos, comp)."""

    def answer(side: np.ndarray, rep: np.ndarray, size: np.ndarray, pos: np.ndarray, comp: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        if alone:
            right = left
        for at, i in enumerate(left):
            k = right[at + 1 :] if alone else right
            k = k[(comp[k] != comp[i]) & possible(size[i], pos[i], size[k], pos[k])]
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[k])), pa.array(np.maximum(rep[i], rep[k]))], names=["a", "b"])

    rest = None
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(6)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        for s, e in zip(starts[:-1], starts[1:]):
            yield from answer(*(c[s:e] for c in cols[1:]))
        rest = [c[starts[-1] :] for c in cols] if len(starts) else None
    if rest is not None and len(rest[0]):
        yield from answer(*rest[1:])


def _second_look(marked: DataFrame, width: int) -> DataFrame | None:
    """Candidates (a, b) of different components in long lists, from ``marked`` (token, rep, size, pos, comp); None if each list has one component.

    A list is dealt into blocks of about ``BLOCK`` sets of like size and position; a component that fills
    blocks of its own has these to itself.  Pairs of blocks meet in tasks of their own, unless their
    sizes and positions rule links out or one component has both.
    """
    mixed = settle(marked.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"))
    if mixed.isEmpty():
        return None
    own = marked.join(mixed, "token").withColumn("k", F.floor(F.log("size") / F.log(F.lit(1.26)))).withColumn("w", F.floor(20 * F.col("pos") / F.col("size")))
    where = ["token", "k", "w"]
    counts = own.groupBy(*where, "comp").agg(F.count("*").alias("n")).withColumn("large", F.when(F.col("n") > BLOCK, F.col("comp")))
    parts = counts.groupBy(*where, "large").agg(F.ceil(F.sum("n") / BLOCK).alias("g"))
    named = counts.alias("c").join(parts.alias("p"), [F.col(f"c.{x}") == F.col(f"p.{x}") for x in where] + [F.col("c.large").eqNullSafe(F.col("p.large"))]).select(*[f"c.{x}" for x in (*where, "comp", "large")], "g")
    block = F.xxhash64(*where, F.coalesce("large", F.lit(0)), F.col("large").isNull(), F.pmod(F.xxhash64("rep", F.lit(4)), F.col("g")))
    rows = settle(own.join(named, [*where, "comp"]).select("token", block.alias("block"), "large", "rep", "size", "pos", "comp"))
    blocks = settle(rows.groupBy("token", "block").agg(F.min("large").alias("large"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("pos").alias("least")))
    x, y = blocks.alias("x"), blocks.alias("y")
    can = " and ".join(("x.block <= y.block", "(x.large is null or y.large is null or x.large <> y.large)", "5 * x.high >= 4 * y.low", "5 * y.high >= 4 * x.low", "5 * x.high - 9 * x.least >= 4 * y.low", "5 * y.high - 9 * y.least >= 4 * x.low"))
    tasks = settle(x.join(y, "token").where(can).select(F.xxhash64("x.token", "x.block", "y.block").alias("task"), "token", F.col("x.block").alias("one"), F.col("y.block").alias("two")))
    sides = tasks.select("task", "token", F.col("one").alias("block"), F.lit(0).alias("side")).union(tasks.where("one <> two").select("task", "token", "two", F.lit(1)))
    dealt = rows.join(sides, ["token", "block"]).select("task", "side", "rep", "size", "pos", "comp")
    return map_arrow(dealt.repartition(width * 2, "task").sortWithinPartitions("task", "side", "rep"), _across, "a long, b long").distinct()


def _bloom(ids: DataFrame) -> np.ndarray:
    """64-bit words of a Bloom filter of the ids' hashes: two bits each; at most one row a word reaches the driver."""
    n = 1 << min(max(ids.count() // 8, 1).bit_length(), BLOOM_WORDS[1].bit_length() - 1)
    n = max(n, BLOOM_WORDS[0])
    bits = None
    for salt in (1, 2):
        h = F.xxhash64("id", F.lit(salt))
        part = ids.select(F.pmod(F.shiftright(h, 6), F.lit(n)).alias("w"), F.expr(f"shiftleft(1L, cast(xxhash64(id, {salt}) & 63 as int))").alias("bit"))
        bits = part if bits is None else bits.union(part)
    got = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(n, np.int64)
    words[got["w"].to_numpy()] = got["bits"].to_numpy()
    return words


def _marked(words: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes[0]), bool)
    for h in hashes:
        ok &= (words[(h >> 6) % len(words)] >> (h & 63)) & 1 == 1
    return ok


def sketch(s: np.ndarray) -> np.ndarray:
    """A quarter of the hash range, cut to 32 bits; shingles that meet so only hide differences."""
    return (s[: np.searchsorted(s, QUARTER)] >> 30).astype(np.uint32)


def _sets(docs: DataFrame, text: str, key: str, ids: DataFrame, whole: bool) -> DataFrame:
    """(id, n, tokens) of at least the documents in ``ids``: whole sets, or sketches."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(ids))
    marked = docs.select(key, F.xxhash64(F.col(key), F.lit(1)).alias("h1"), F.xxhash64(F.col(key), F.lit(2)).alias("h2"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in slices(batches, 512):
            b = b.filter(pa.array(_marked(words, b.column(1).to_numpy(), b.column(2).to_numpy())))
            if b.num_rows:
                sets = [shingle_set(t) for t in b.column(3).to_pylist()]
                data = [(s if whole else sketch(s)).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(data, pa.binary())], names=["id", "n", "tokens"])

    return map_arrow(marked.where(F.col(key).isNotNull()), run, "id long, n int, tokens binary")


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    if len(s) > len(t):
        s, t = t, s
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ by no more than linked sets of their sizes can."""
    for b in slices(batches, 512):
        keep = []
        for s, t, n, m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
            s, t = np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32)
            most = n + m - 2 * ((4 * (n + m) + 8) // 9)
            keep.append(len(s) + len(t) - 2 * _overlap(s, t) <= most)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 512):
        x, y, u, v = [], [], b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, (s, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            s, t = np.frombuffer(s, np.int64), np.frombuffer(t, np.int64)
            both = _overlap(s, t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                x.append(u[i])
                y.append(v[i])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["u", "v"])


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``left`` links with each of ``right``, derived from how the sets differ from one of them.

    Sets s and t that differ from the first set by S and T differ from each other by the shingles in one of S
    and T only.  So between ``||S| - |T||`` and ``|S| + |T|`` shingles differ, which decides most pairs of like sets; for the
    others only the shared part of S and T is counted, and never what the sets have in common.
    """
    sets = [*left, *right]
    apart = [np.setxor1d(sets[0], s, assume_unique=True) for s in sets]
    n, d = np.array([len(s) for s in sets], np.int64), np.array([len(x) for x in apart], np.int64)
    a, b, da, db = n[: len(left), None], n[None, len(left) :], d[: len(left), None], d[None, len(left) :]
    most = a + b - 2 * needed(a, b)
    said = da + db <= most
    asked = ~said & (np.abs(da - db) <= most)
    rows, cols = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
    if len(rows):
        both = _shared([apart[i] for i in rows], [apart[len(left) + j] for j in cols])
        at = np.ix_(rows, cols)
        said[at] |= (da + db)[at] - 2 * both <= most[at]
    return said


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections, from a product of membership columns of the elements that two sets share."""
    sets = [*left, *right]
    at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = n[at] > 1
    row, col = row[twice], (np.cumsum(n > 1) - 1)[at[twice]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        part = slice(*np.searchsorted(col, (first, first + COLUMNS)))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[part], col[part] - first] = 1
        both += m[: len(left)] @ m[len(left) :].T
    return both.astype(np.int64)


TASK = ("comp", "k", "i", "l", "j")


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(u, v, copies of u, copies of v) of the links of each pair of blocks; rows come sorted by (task, side, rep)."""

    def answer(side: np.ndarray, rep: np.ndarray, copies: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, ...]:
        keep = np.ones(len(rep), bool)  # repeated rows have repeated sets
        keep[1:] = (rep[1:] != rep[:-1]) | (side[1:] != side[:-1])
        x = np.flatnonzero(keep & (side == 0))
        y = np.flatnonzero(keep & (side == 1))
        sets = {i: np.frombuffer(tokens[i], np.int64) for i in (*x, *y)}
        if not len(x):
            return (rep[:0],) * 4
        if len(y):
            i, j = np.nonzero(linked([sets[i] for i in x], [sets[i] for i in y]))
        else:  # a block with itself, or one whose partner has no rows
            y = x
            same = [sets[i] for i in x]
            i, j = np.nonzero(np.triu(linked(same, same), 1))
        return rep[x[i]], rep[y[j]], copies[x[i]], copies[y[j]]

    rest: tuple | None = None
    for b in slices(batches, 512):
        task = np.stack([b.column(i).to_numpy() for i in range(5)], 1)
        cols = [task, *(b.column(i).to_numpy() for i in (5, 6, 7))]
        tokens = b.column(8).to_pylist()
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest[0], cols)]
            tokens = rest[1] + tokens
        task = cols[0]
        starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]).any(1)])
        for s, e in zip(starts[:-1], starts[1:]):
            yield answer(*(c[s:e] for c in cols[1:]), tokens[s:e])
        rest = [c[starts[-1] :] for c in cols], tokens[starts[-1] :]
    if rest is not None and len(rest[1]):
        yield answer(*rest[0][1:], rest[1])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, v, _, _ in _block_pairs(batches):
        for i in range(0, len(u), 8192):
            x, y = u[i : i + 8192], v[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, v, cu, cv in _block_pairs(batches):
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, at, np.concatenate([cv, cu]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["rep", "n"])


def _blocks(crowd: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Rows (task, side, rep, copies, tokens) of ``crowd`` (rep, comp, size, copies), each once for every pair of blocks it belongs to.

    Sets whose sizes differ by more than a factor of 1.25 cannot link, so they are in neighbouring classes of a factor of 1.26 at most.
    """
    crowd = crowd.withColumn("k", F.floor(F.log("size") / F.log(F.lit(1.26))))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_TOKENS))
    parts = settle(crowd.groupBy("comp", "k").agg(parts.alias("g")))
    around = parts.join(parts.select("comp", (F.col("k") + 1).alias("k"), F.col("g").alias("before")), ["comp", "k"], "left").join(parts.select("comp", (F.col("k") - 1).alias("k"), F.col("g").alias("after")), ["comp", "k"], "left")
    own = crowd.join(around, ["comp", "k"]).withColumn("p", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("g")))
    tasks = F.expr(
        """concat(
        transform(sequence(0L, g - 1), x -> struct(k as k, least(p, x) as i, k as l, greatest(p, x) as j, int(p > x) as side)),
        if(after is null, array(), transform(sequence(0L, after - 1), x -> struct(k as k, p as i, k + 1 as l, x as j, 0 as side))),
        if(before is null, array(), transform(sequence(0L, before - 1), x -> struct(k - 1 as k, x as i, k as l, p as j, 1 as side))))"""
    )
    dealt = own.select("comp", "rep", "copies", F.explode(tasks).alias("t")).select("comp", "t.*", "rep", "copies")
    rows = dealt.join(sets.select(F.col("id").alias("rep"), "tokens"), "rep").select(*TASK, "side", "rep", "copies", "tokens")
    return rows.repartition(width * 2, *TASK).sortWithinPartitions(*TASK, "side", "rep")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("s"), F.col("n").alias("sn")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("t"), F.col("n").alias("tn")), "b")
    return two.select("a", "b", "s", "t", "sn", "tn")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Pairs (u, v) of representatives whose sets link."""
    likely = settle(map_arrow(_beside(pairs, sketches), _plausible, "a long, b long").distinct())
    sets = settle(_sets(docs, text, key, _ends(likely), whole=True))
    return map_arrow(_beside(likely, sets), _verify, "u long, v long").distinct()


def _grouped(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, links, components, long lists, classes of several rows): components are right, but links inside them are not all there."""
    spark: SparkSession = docs.sparkSession
    width = shuffle_width(spark)
    order = Order(*_common(docs, text, key))
    rows = _entries(docs, text, key, order).repartition(width * 2, "token", "salt").sortWithinPartitions("token", "salt", "pos", "size", "ent")
    found = settle(map_arrow(rows, _read_lists, FOUND))
    members = found.where(f"kind = {MEMBER}").select(F.col("a").alias("id"), F.col("an").alias("n"), F.col("b").alias("e"))
    classes = settle(members.where("n > 0").groupBy("e", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    rep = lambda e, n, name: classes.select(F.col("e").alias(e), F.col("n").alias(n), F.col("rep").alias(name))
    pairs = found.where(f"kind = {PAIR}").select("a", "an", "b", "bn").distinct()
    pairs = pairs.join(rep("a", "an", "x"), ["a", "an"]).join(rep("b", "bn", "y"), ["b", "bn"])
    pairs = settle(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    longs = found.where(f"kind = {LONG}").select(F.col("a").alias("token"), F.col("an").alias("pos"), F.col("b").alias("e"), F.col("bn").alias("n")).distinct()
    longs = settle(longs.join(classes.select("e", "n", "rep"), ["e", "n"]).select("token", "rep", F.col("n").alias("size"), "pos"))
    sketches = settle(_sets(docs, text, key, _ends(pairs).union(longs.select("rep")), whole=False))
    links = settle(_links(pairs, sketches, docs, text, key))
    joined = components(links)
    marked = longs.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "size", "pos", F.coalesce("component", "rep").alias("comp"))
    across = _second_look(settle(marked), width)
    across = None if across is None else settle(across.join(pairs, ["a", "b"], "left_anti"))
    if across is not None and not across.isEmpty():
        links = links.union(settle(_links(across, sketches, docs, text, key)))
        joined = components(links)
    copies = settle(classes.where("copies > 1").select("e", "n", "rep", "copies"))
    whole = members.join(copies.drop("copies"), ["e", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = whole.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    return out, links, joined, longs, copies.select("rep", "copies")


def similarity_join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, links): key, n_shingles, class_id, component_id, n_links for every row; and all links between class representatives."""
    out, links, joined, longs, copies = _grouped(docs, text, key)
    once = F.coalesce("copies", F.lit(1).cast("long")).alias("copies")
    many = joined.groupBy("component").count().where("count > 1").select("component")  # a component of two has its only link
    nodes = joined.join(many, "component")
    nodes = nodes.select("node", "component").union(many.select("component", "component"))
    crowd = longs.select("rep", "size").distinct().join(nodes.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep")
    crowd = settle(crowd.join(copies, "rep", "left").select("rep", "comp", "size", once))
    rows = None
    if not crowd.isEmpty():
        sets = settle(_sets(docs, text, key, crowd.select(F.col("rep").alias("id")), whole=True))
        rows = _blocks(crowd, sets, shuffle_width(docs.sparkSession))
    inside = crowd.select(F.col("rep").alias("u"), F.lit(True).alias("cu")), crowd.select(F.col("rep").alias("v"), F.lit(True).alias("cv"))
    other = links.join(inside[0], "u", "left").join(inside[1], "v", "left").where("cu is null or cv is null").select("u", "v").distinct()
    ways = other.union(other.select("v", "u")).join(copies.withColumnRenamed("rep", "v"), "v", "left").select(F.col("u").alias("rep"), once.alias("n"))
    if rows is not None:
        ways = ways.union(map_arrow(rows, _block_counts, "rep long, n long"))
        links = other.union(map_arrow(rows, _block_links, "u long, v long"))
    counts = settle(ways.groupBy("rep").agg(F.sum("n").alias("n_links")).join(copies, "rep", "full").select("rep", (F.coalesce("n_links", F.lit(0)) + once - 1).alias("n_links")))
    members = out.join(counts, out["class_id"] == counts["rep"], "left").select(*out.columns, F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    return members, links


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key (of repeated rows, one).

    Only rows that a Bloom filter marks as leaving or repeated are shuffled; the others stay where they are.
    """
    groups = _grouped(docs, text, key)[0]
    named = groups.where(F.col(key).isNotNull())
    leaves = settle(named.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("id")).union(named.groupBy(key).count().where("count > 1").select(key)).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(leaves))
    hashes = [spare(docs.columns, "h1"), spare(docs.columns, "h2")]
    hashed = docs.select("*", *[F.xxhash64(F.col(key), F.lit(i)).alias(h) for i, h in enumerate(hashes, 1)])

    def split(marked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            for b in slices(batches, 512):
                ok = _marked(words, b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]).filter(pa.array(ok == marked))

        return map_arrow(hashed, run, docs.schema)

    gone = named.where(F.col(key) != F.col("component_id")).select(key).distinct()
    maybe = split(True).join(gone, key, "left_anti").select(*docs.columns)
    nulls = maybe.where(F.col(key).isNull())
    repeated = maybe.where(F.col(key).isNotNull())
    rest = [c for c in docs.columns if c != key]
    # Of repeated keys the row with the smallest text, then the smallest other columns that can be ordered.
    rank = F.struct(F.col(text), *[F.col(f"`{c}`") for c in rest if c != text and not _unordered(docs.schema[c].dataType)])
    least = repeated.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("row")).select(*[F.col(key) if c == key else F.col("row").getField(c).alias(c) for c in docs.columns])
    return split(False).union(nulls).union(least)


def _unordered(kind: DataType) -> bool:
    """Whether Spark cannot compare values of this type."""
    return any(x in kind.simpleString() for x in ("map<", "variant", "interval"))
