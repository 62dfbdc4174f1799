"""Marker lexicons: surface patterns as data, token patterns compiled to regular expressions.

A surface entry is (type, name, function, subclass, pattern).  Token patterns are sequences over tokens with the fields
orth, norm, lemma, pos, tag, morph; ``compile_tokens`` turns one into a regular expression over the text
``orth|norm|lemma|pos|tag|morph;`` of each token, so that matching stays a native column.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

CONNECTIVE, FINAL = "接続表現", "文末表現"
FIELDS = ("ORTH", "NORM", "LEMMA", "POS", "TAG", "MORPH")


@dataclass(frozen=True)
class Entry:
    type: str
    name: str
    function: str
    subclass: str
    pattern: str


# Sentence-initial words and sentence-final endings of the bundled test lexicon.
_FIRST = {"the": "1論理・順接・だから", "of": "1論理・逆接・しかし", "and": "2整理・並列・そして", "to": "2整理・列挙・まず", "in": "2整理・対比・いっぽう", "is": "3理解・換言・つまり", "that": "3理解・例示・たとえば", "der": "1論理・順接・だから", "die": "1論理・逆接・しかし", "und": "2整理・並列・そして", "la": "2整理・列挙・まず", "de": "3理解・補足・ただし", "que": "3理解・換言・つまり", "el": "2整理・対比・いっぽう"}
_LAST = {"tion": "断定", "the": "断定", "er": "推量・意志", "en": "推量・意志", "ed": "認識", "ing": "認識", "ly": "可能", "is": "断定・存在", "and": "NA", "ment": "疑問", "ung": "疑問"}

FIXTURE = [Entry(CONNECTIVE, w, f, "新", f"(?i)^\\s*({w})(?:[^\\p{{L}}]|$)") for w, f in _FIRST.items()] + [Entry(FINAL, w, f"{c}、{w}", c, f"(?i)({w})[.!?]?\\s*$") for w, c in _LAST.items()]

# The 34 connectives that are shipped as surface patterns: name, pattern, function.
_SURFACE = """あと|(あと|後)|2整理・並列・それに
あとは|(あと|後)は|2整理・並列・それに
あわせて|あわせて|2整理・並列・それに
いか（以下）|(いか|以下)|2整理・列挙・最初に
いかで（以下で）|(いか|以下)で|2整理・列挙・最初に
いかでは（以下では）|(いか|以下)では|2整理・列挙・最初に
いかに（以下に）|(いか|以下)に|2整理・列挙・最初に
いかは（以下は）|(いか|以下)は|2整理・列挙・最初に
いご（以後）|(いご|以後)|2整理・列挙・最初に
いこう（以降）|(いこう|以降)|2整理・列挙・最初に
いらい（以来）|(いらい|以来)|2整理・列挙・最初に
うち|(うち|内)|3理解・例示・とくに
けど|けど|1論理・逆接・しかし
だが|だが|1論理・逆接・しかし
だから|だから|1論理・順接・だから
だからこそ|だからこそ|1論理・順接・だから
だからといって|だからと(い|云|言)って|1論理・逆接・しかし
だけど|だけど|1論理・逆接・しかし
たほう（他方）|(たほう|他方)|2整理・対比・いっぽう
ちなみに|(ちなみ|因)に|3理解・補足・ただし
ついで|(つ|次)いで|2整理・列挙・最初に
ついでに|(つ|次)いでに|2整理・列挙・最初に
つか|つか|3理解・換言・むしろ
で|で|1論理・順接・だから
と|と|1論理・順接・それなら
ので|ので|1論理・順接・だから
ほか（他）|(ほか|他)|2整理・対比・いっぽう
まして|(ま|況|増)して|2整理・並列・それに
まず|(ま|先)ず|2整理・列挙・まず
また|(また|又)|2整理・並列・そして
もとより|(もと|元|固|素)より|1論理・順接・だから
ようは（要は）|(よう|要)は|3理解・換言・つまり
よって（因って）|(よ|因)って|1論理・順接・だから
れいとして（例として）|(れい|例)として|3理解・例示・たとえば"""


def connectives() -> list[Entry]:
    """The shipped connectives: at a sentence's start, after blanks, digits and an opening bracket, before a comma; spans hold the words alone."""
    out = []
    for line in _SURFACE.splitlines():
        name, _, rest = line.partition("|")
        pattern, _, function = rest.rpartition("|")
        words = pattern.replace("(", "(?:")
        out.append(Entry(CONNECTIVE, name, function, "新", f"(?U)^[\\s　\\d０-９]*「?({words})[、,，]"))
    return out


def names_of(s: str) -> set[str]:
    """All names that a definition gives: parts before and inside brackets, each of several, and the whole."""
    plain = re.sub(r"（[^）]*）", "", s)
    inner = re.findall(r"（([^）]*)）", s)
    parts = [p for p in s.split("、") if p]
    out = {p for p in plain.split("、") if p} | set(inner) | set(parts)
    return out | ({plain} if plain else set())


class Either(tuple):
    """Alternatives of a token pattern; lists are sequences."""


def expand(pattern) -> list[list[dict]]:
    """All plain sequences of a pattern of lists, ``Either`` and token constraints."""
    if isinstance(pattern, Either):
        return [s for branch in pattern for s in expand(branch)]
    if isinstance(pattern, dict):
        return [[pattern]]
    return [sum(parts, []) for parts in itertools.product(*(expand(p) for p in pattern))]


def _field(constraint) -> str:
    quote = lambda v: re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", str(v))
    if isinstance(constraint, str):
        return quote(constraint)
    if "IN" in constraint:
        return "(?:" + "|".join(map(quote, constraint["IN"])) + ")"
    if "NOT_IN" in constraint:
        return "(?!(?:" + "|".join(map(quote, constraint["NOT_IN"])) + r")[|;])[^|;]*"
    if "REGEX" in constraint:
        rx = constraint["REGEX"]
        return ("" if rx.startswith("^") else "[^|;]*") + "(?:" + rx.strip("^").rstrip("$") + ")" + ("" if rx.endswith("$") else "[^|;]*")
    raise ValueError(f"unknown constraint {constraint}")


def compile_tokens(pattern) -> str:
    """A regular expression over encoded tokens; ``OP`` may be ``?``, ``*``, ``+`` or ``!``."""
    if isinstance(pattern, Either):
        return "(?:" + "|".join(compile_tokens(p) for p in pattern) + ")"
    if not isinstance(pattern, dict):
        return "".join(compile_tokens(p) for p in pattern)
    fields = [_field(pattern[f]) if f in pattern else "[^|;]*" for f in FIELDS]
    one = r"\|".join(fields) + ";"
    if pattern.get("IS_SENT_START"):
        one = "^" + one
    op = pattern.get("OP", "")
    return f"(?!{one})(?:[^;]*;)" if op == "!" else f"(?:{one}){op}"
