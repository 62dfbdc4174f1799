"""SentencePiece BPE encoding and decoding with a prefix table.

For every prefix of a chunk the last token of its encoding is unique, so one table entry per
position is enough: the automaton lists the vocabulary pieces that end at a position, and the one
that is compatible with the last token of the prefix before it is stored.  Two tokens are compatible
when no merge across their border comes before the merges that made them, which is when encoding
their joined text gives back the two tokens.  Ids are read off the table backwards.

Chunks end before each white-space mark and around characters that no piece holds (they fall back to
bytes), as no merge can cross these places; a chunk's ids are kept in a bounded cache.  Runs of
white-space marks have tied scores in the vocabulary, so a run's ids come from merging it step by
step in the library's order (highest score, then leftmost).

Defined results: null text encodes like the empty text, to no ids.  Texts of any length are encoded
whole.  Repeated rows and null keys give a row each, an empty table none; columns other than key and text
are not read, so clashing names do not matter.  Tied scores are merged leftmost first.  A literal U+2581 in a text is a white-space mark, as in the library, and decodes to a space.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tsuzuri.llm.common import map_arrow, slices, trim

MARK = "▁"
#: Most that a worker keeps of each: chunks after a white-space mark and other chunks (their ids as 16-bit
#: numbers, about 150 bytes a chunk, 60 MB in all), and pairs of tokens already compared (about 90 bytes each).  Each is
#: emptied when it is full, and chunks at the end of each task, as workers live on for later stages.
CACHE_CHUNKS, CACHE_BARE, CACHE_PAIRS = 400_000, 40_000, 160_000
#: Longest chunk that is kept, in characters; longest run of spaces whose ids are.
KEPT_CHARS, KEPT_RUN, KEPT_RUNS = 64, 64, 64
UNREACHED = -1 << 60


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("tsuzuri_each_byte", _each_byte)


class PrefixBpe:
    """Encoder and decoder for a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model: str) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.rank = {p: (-lib.get_score(i), i) for i, p in enumerate(pieces) if not special[i]}
        self.bytes_of = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(pieces, special)]
        self.byte_id = [0] * 256
        for i, p in enumerate(pieces):
            if lib.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
        self.bytes_of[lib.unk_id()] = " ⁇ ".encode()
        self.first_of = list(self.bytes_of)
        for i, p in enumerate(pieces):
            if not special[i] and p.startswith(MARK):
                self.first_of[i] = self.bytes_of[i][1:]
        self.text_of = pieces
        self.decimal = [str(i) for i in range(n)]
        self.chars = {c for p in self.rank for c in p}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.rank):
            raise ValueError("a piece holds a white-space mark after other characters")
        self.mark = self.rank[MARK][1]
        self.width = [len(p) for p in pieces]
        self.ids = list(range(n))
        self.kind = "H" if n <= 1 << 16 else "I"
        self.lone_mark = array(self.kind, [self.mark]).tobytes()
        self.start = n << 20
        self.apart: set[int] = set()  # pairs of tokens that stay apart, and pairs that do not
        self.merged: set[int] = set()
        self.order, self.left_of, self.right_of = [0.0] * n, list(range(n)), list(range(n))
        self.automaton = ahocorasick.Automaton()
        for p, (score, i) in list(self.rank.items()):
            if p == MARK or p.strip(MARK):
                if parts := self._parts(i):  # a piece that its own parts never reach ends no prefix
                    self.automaton.add_word(p, (i, len(p), i << 20))
                    self.left_of[i], self.right_of[i] = parts
                    self.order[i] = score if len(p) > 1 else 0.0
        self.automaton.make_automaton()
        self.with_mark: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}

    def _merge(self, s: str) -> list[int]:
        """The library's own order on a short text: merge the best pair until none is left."""
        rank, n = self.rank, len(s)
        sym: list[str] = list(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*rank[p][:1], i, p) for i in range(n - 1) if (p := s[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i] if sym[i] else n
            if j >= n or sym[i] + sym[j] != p or not sym[i]:
                continue
            sym[i], sym[j] = p, ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (q := p + sym[right[i]]) in rank:
                    heapq.heappush(heap, (rank[q][0], i, q))
            if left[i] >= 0 and (q := sym[left[i]] + p) in rank:
                heapq.heappush(heap, (rank[q][0], left[i], q))
        out: list[int] = []
        for x in sym:
            if x:
                out += [rank[x][1]] if x in rank else [self.byte_id[b] for b in x.encode()]
        return out

    def _parts(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None if its own text is encoded otherwise."""
        s = self.text_of[i]
        if len(s) == 1:
            return i, i
        if self._merge(s) != [i]:
            return None
        rank = self.rank
        for k in range(1, len(s)):
            if s[:k] in rank and s[k:] in rank:
                a, b = rank[s[:k]], rank[s[k:]]
                if self._merge(s[:k]) == [a[1]] and self._merge(s[k:]) == [b[1]] and self._without(s, i) == [a[1], b[1]]:
                    return a[1], b[1]
        return None

    def _without(self, s: str, i: int) -> list[int]:
        kept = self.rank.pop(s)
        out = self._merge(s)
        self.rank[s] = kept
        return out

    def _fits(self, key: int) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before the merges that made them."""
        a, b = key >> 20, key & 0xFFFFF
        text, rank, order, limit, ok = self.text_of, self.rank, self.order, float("inf"), True
        while ok and a < len(text):  # any token fits the start
            made = rank.get(text[a] + text[b])
            if made is not None and made[0] < limit:
                ok = False
            elif order[a] > order[b]:
                limit, a = order[a], self.right_of[a]
            elif order[b] > 0:
                limit, b = order[b] + 1, self.left_of[b]
            else:
                break
        if len(self.apart) + len(self.merged) >= CACHE_PAIRS:
            self.apart.clear()
            self.merged.clear()
        (self.apart if ok else self.merged).add(key)
        return ok

    def _known(self, s: str) -> list[int]:
        """Ids of a chunk whose characters are all in the vocabulary."""
        n = len(s)
        last = [UNREACHED] * (n + 1)  # last token of the prefix that ends at each place, shifted; the empty prefix is at -1
        last[n] = self.start
        apart, merged, fits = self.apart, self.merged, self._fits
        for end, (i, k, shifted) in self.automaton.iter(s):
            if last[end] < 0:
                key = last[end - k] + i
                if key in apart or key >= 0 and key not in merged and fits(key):
                    last[end] = shifted
        out, at, width, ids = [], n - 1, self.width, self.ids
        while at >= 0:
            i = ids[last[at] >> 20]
            out.append(i)
            at -= width[i]
        out.reverse()
        return out

    def _chunk(self, s: str) -> list[int]:
        """Ids of a chunk, cut around characters that no piece holds."""
        if self.chars.issuperset(s):
            return self._known(s)
        inside, at, out = self.inside, 0, []
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i - 1 : i + 1] not in inside:
                out += self._known(s[at:i]) if s[at] in self.chars else [self.byte_id[b] for b in s[at:i].encode()]
                at = i
        return out

    def _run(self, n: int) -> bytes:
        ids = self.runs.get(n)
        if ids is None:
            ids = array(self.kind, self._merge(MARK * n)).tobytes()
            if n <= KEPT_RUN and len(self.runs) < KEPT_RUNS:
                self.runs[n] = ids
        return ids

    def _line(self, words: list[str], out: array) -> None:
        """Ids of a line that holds runs of spaces; words[0] has no mark before it."""
        if words[0]:
            out.frombytes(self._get(self.bare, words[0], words[0]))
        n = 0
        for w in words[1:]:
            n += 1
            if w:
                ids = self._get(self.with_mark, w, MARK + w)
                if ids.startswith(self.lone_mark):
                    out.frombytes(self._run(n))
                    out.frombytes(ids[len(self.lone_mark) :])
                else:
                    if n > 1:
                        out.frombytes(self._run(n - 1))
                    out.frombytes(ids)
                n = 0
        if n:
            out.frombytes(self._run(n))

    def _get(self, kept: dict[str, bytes], w: str, s: str) -> bytes:
        ids = kept.get(w)
        if ids is None:
            ids = array(self.kind, self._chunk(s)).tobytes()
            if len(w) <= KEPT_CHARS:
                if len(kept) >= (CACHE_CHUNKS if kept is self.with_mark else CACHE_BARE):
                    kept.clear()
                kept[w] = ids
        return ids

    def release(self) -> None:
        """Forget the chunks of this task's texts."""
        for kept in (self.with_mark, self.bare, self.runs):
            kept.clear()

    def encode(self, text: str | None) -> array:
        out = array(self.kind)
        if not text:
            return out
        if MARK in text:
            text = text.replace(MARK, " ")
        newline, first, kept, add = self.byte_id[10], True, self.with_mark, out.frombytes
        split_at = "\n" if "\n" not in self.chars else None
        runs = "  " in text or " \n" in text or text[-1] == " " or text[0] == " "
        for line in text.split(split_at) if split_at else [text]:
            words = line.split(" ")
            if first:
                words.insert(0, "")
                first = False
            else:
                out.append(newline)
            if runs and "" in words[1:]:
                self._line(words, out)
                continue
            if words[0]:
                add(self._get(self.bare, words[0], words[0]))
            words[0] = ""
            ids = list(map(kept.get, words))
            ids[0] = b""
            if None in ids:
                ids = [self._get(kept, w, MARK + w) if x is None else x for w, x in zip(words, ids)]
            add(b"".join(ids))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        if not len(ids):
            return ""
        table = self.bytes_of
        body = self.first_of[ids[0]] + b"".join([table[i] for i in ids[1:]])
        return body.decode("utf-8", "tsuzuri_each_byte")

    def joined(self, ids: Sequence[int]) -> str:
        dec = self.decimal
        return ",".join([dec[i] for i in ids])


@lru_cache(maxsize=2)
def codec(model: str) -> PrefixBpe:
    return PrefixBpe(model)


def encode_documents(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", with_ids: bool = True, digests: bool = False, decoded: bool = False) -> DataFrame:
    """``key``, ``n_tokens`` and, as asked for, ``ids`` (array of int), ``decoded`` text or their digests; one row for each input row."""
    field = docs.schema[key]
    schema = f"`{key}` {field.dataType.simpleString()}, n_tokens bigint"
    schema += ", ids array<int>" if with_ids else ""
    schema += ", decoded string" if decoded else ""
    schema += ", ids_sha256 string, decoded_sha256 string" if digests else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(model)
        for b in slices(batches):
            n, ids_out, back, one, two = [], [], [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids))
                if with_ids:
                    ids_out.append(pa.array(np.frombuffer(ids, bpe.kind).astype(np.int32)) if ids else pa.array([], pa.int32()))
                if decoded:
                    back.append(bpe.decode(ids))
                if digests:
                    one.append(hashlib.sha256(bpe.joined(ids).encode()).hexdigest())
                    two.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            cols, names = [b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"]
            if with_ids:
                lens = pa.array([0, *accumulate(n)], pa.int32())
                flat = pa.concat_arrays(ids_out) if ids_out else pa.array([], pa.int32())
                cols.append(pa.ListArray.from_arrays(lens, flat))
                names.append("ids")
            if decoded:
                cols.append(pa.array(back, pa.string()))
                names.append("decoded")
            if digests:
                cols += [pa.array(one, pa.string()), pa.array(two, pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        bpe.release()
        trim()

    return map_arrow(docs.select(key, text), run, schema)
