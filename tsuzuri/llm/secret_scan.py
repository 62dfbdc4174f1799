"""Secret scans with native columns only: pattern kinds, and sliding-window entropy over candidate strings.

Spans are (start, end) in code points, end exclusive.  ``split`` gives the text between matches and
``regexp_extract_all`` the matches, so their lengths give the places without a Python function.

Entropy kind: a candidate is a longest run of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters
that holds a digit.  One fold walks the run once; each step adds the entering character, takes the
leaving one from the counts, and corrects the running sum of c*log2(c), which gives the window's
Shannon entropy.  Its threshold depends on the run's character class (hexadecimal, one case with
digits, mixed).  The span reaches from the first to the last window above the threshold.  Runs on the
allow-list, and runs that touch a span of the other kinds, are suppressed.

Defined results: a null text has no spans; an empty text neither; rows are never dropped, and
repeated rows and null keys each give their own result; an empty table gives none.  Spans of a start are in
the order of ``KINDS``.  Folds work on groups of matches, so long texts with many matches take time in
proportion to them, nearly.  ``report`` reads only key and text; ``scan`` replaces a column named like ``into``;
``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import read_few, spare

WINDOW = 20
#: Matches that a fold copies at a time.
GROUP = 64

# The base kinds' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "entropy")

# Thresholds in bits by class; the most that a window of 20 can have is log2(20) = 4.32.
THRESHOLDS = {"hex": 3.0001, "single": 3.6001, "mixed": 3.8001}
# A path's segment: words of one case or capitalised, joined by - or _ or as camel case, with short numbers.
WORD = r"(?:(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[a-z]*(?:[A-Z][a-z]+)+)[0-9]{0,4}|[0-9]{1,4})"
PART = rf"[_-]*{WORD}(?:[_-]+{WORD})*[_-]*"
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    r"(?i)abcdefghij|0123456789|9876543210",
    r"(?i)^(sha1|sha256|sha384|sha512|md5)[-=_]",
    rf"^(?=[A-Za-z_-]+/){PART}(/{PART})+/?$",
)


SPAN = "array<struct<s:int,k:int,e:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _groups(items: Column, size: int = GROUP) -> Column:
    """``items`` in groups of ``size``, so that folds copy groups and not all that came before."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda g: F.slice(x, g * size + 1, F.lit(size)))
    return _let(items, lambda x: F.when(F.size(x) > 0, cut(x)))


def _folded(items: Column, start: Column, step, kind: str) -> Column:
    """What ``step(acc, item)`` gives for each item, in order; ``start`` is the first ``at`` and a result's ``at`` goes on to the next."""

    def inner(acc: Column, x: Column) -> Column:
        return _let(step(acc["at"], x), lambda one: F.struct(one["at"].alias("at"), F.array_append(acc["out"], one["out"]).alias("out")))

    def outer(acc: Column, group: Column) -> Column:
        got = F.aggregate(group, F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out")), inner)
        return _let(got, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    none = F.expr(f"cast(array() as array<array<{kind}>>)")
    return F.coalesce(F.flatten(F.aggregate(_groups(items), F.struct(start.alias("at"), none.alias("out")), outer, lambda acc: acc["out"])), F.expr(f"cast(array() as array<{kind}>)"))


def _places(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Array of struct(s, e, m) of the pattern's leftmost matches; with ``group``, only those whose group has ``least`` characters."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    both = F.zip_with(found, sizes, lambda m, n: F.struct(m.alias("m"), n.alias("i")))
    parts = F.zip_with(both, F.slice(between, F.lit(1), F.size(found)), lambda x, b: F.struct(F.length(b).alias("b"), x["m"].alias("m"), x["i"].alias("i")))

    def step(at: Column, x: Column) -> Column:
        s = at + x["b"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["i"].alias("i")).alias("out"))

    places = F.filter(_folded(parts, F.lit(0), step, "struct<s:int,e:int,m:string,i:int>"), lambda p: p["i"] >= (least if group is not None else 0))
    out = F.transform(places, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["m"].alias("m")))
    return F.when(text.rlike(pattern), out).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)"))


def window_entropy(run: Column, threshold: Column) -> Column:
    """struct(first, last): 1-based ends of the first and last window of ``run`` whose entropy reaches the threshold; 0 if none."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    signs = F.slice(F.split(run, ""), F.lit(1), F.length(run))
    codes = _let(F.array_distinct(signs), lambda known: F.transform(signs, lambda c: (F.array_position(known, c) - 1).cast("int")))
    steps = _let(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), c), F.lit(1), F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    start = F.struct(F.array_repeat(F.lit(0), F.size(F.array_distinct(signs))).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    most = F.lit(math.log2(WINDOW)) - threshold

    def step(acc: Column, x: Column) -> Column:
        gone = F.coalesce(F.get(acc["n"], x["b"]), F.lit(0))
        came = F.get(acc["n"], x["a"]) - F.when(x["a"] == x["b"], 1).otherwise(0)
        total = acc["sum"] + F.when(x["b"] >= 0, F.get(terms, gone - 1) - F.get(terms, gone)).otherwise(0.0) + F.get(terms, came + 1) - F.get(terms, came)
        n = F.transform(acc["n"], lambda c, k: c + F.when(k == x["a"], 1).otherwise(0) - F.when(k == x["b"], 1).otherwise(0))
        return F.struct(n.alias("n"), total.alias("sum"), (acc["i"] + 1).alias("i"), acc["first"].alias("first"), acc["last"].alias("last"))

    def full(acc: Column, x: Column) -> Column:
        return _let(step(acc, x), lambda y: F.struct(y["n"].alias("n"), y["sum"].alias("sum"), y["i"].alias("i"), F.when(_high(y, most) & (y["first"] == 0), y["i"]).otherwise(y["first"]).alias("first"), F.when(_high(y, most), y["i"]).otherwise(y["last"]).alias("last")))

    return F.aggregate(steps, start, full, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _high(acc: Column, most: Column) -> Column:
    return (acc["i"] >= WINDOW) & (acc["sum"] / WINDOW <= most)


def _threshold(run: Column) -> Column:
    return (
        F.when(run.rlike("^[0-9A-Fa-f]+$"), THRESHOLDS["hex"])
        .when(run.rlike("^[a-z0-9+/_=-]+$|^[A-Z0-9+/_=-]+$"), THRESHOLDS["single"])
        .otherwise(THRESHOLDS["mixed"])
    )


def _entropy_places(text: Column, base: Column) -> Column:
    bounds = F.transform(_groups(base), lambda g: F.struct(F.array_min(F.transform(g, lambda b: b["s"])).alias("s"), F.array_max(F.transform(g, lambda b: b["e"])).alias("e"), g.alias("g")))

    def free(p: Column, bounds: Column) -> Column:
        meets = lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"])
        ok = ~F.coalesce(F.exists(bounds, lambda g: meets(g) & F.exists(g["g"], meets)), F.lit(False))
        for pattern in ALLOWED:
            ok = ok & ~p["m"].rlike(pattern)
        return ok

    runs = _let(bounds, lambda known: F.filter(_places(text, RUN), lambda p: free(p, known)))
    measured = F.transform(runs, lambda p: F.struct(p["s"].alias("s"), window_entropy(p["m"], _threshold(p["m"])).alias("w")))
    kept = F.filter(measured, lambda p: p["w"]["last"] > 0)
    return F.transform(kept, lambda p: F.struct((p["s"] + p["w"]["first"] - WINDOW).alias("s"), F.lit(3).alias("k"), (p["s"] + p["w"]["last"]).alias("e")))


def _of_kind(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with a column ``into``: array of struct(s, k, e), sorted by start, then kind (index in ``KINDS``)."""
    read_few(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [_places(t, ASSIGN, 2, ASSIGN_MIN), _places(t, ACCESS), _places(t, HEX)]
    base = F.concat(*[_of_kind(p, k) for k, p in enumerate(kinds)])
    found = docs.withColumn(into, base)
    return found.withColumn(into, F.array_sort(F.concat(F.col(into), F.when(t.rlike(RUN), _entropy_places(t, F.col(into))).otherwise(F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text; one row for each input row."""
    s = F.col("secrets")
    count = lambda k: F.size(F.filter(s, lambda x: x["k"] == k)).cast("long")
    return scan(docs.select(key, text), text).select(
        key,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.filter(s, lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "<secret>") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; spans that meet are replaced as one.

    Groups of spans are cut out of the text first, so that a span is not looked for from the text's start.
    """
    t, into = F.col(f"`{text}`"), spare(docs.columns, "secrets")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), joined).otherwise(F.array_append(acc, F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def clean(at: Column, g: Column) -> Column:
        def cut(stop: Column) -> Column:
            inner = lambda part: F.aggregate(
                F.filter(g, lambda x: x["e"] > at),
                F.struct(at.alias("at"), F.lit("").alias("out")),
                lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(part, acc["at"] - at + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.when((x["s"] > acc["at"]) | (acc["at"] == 0), mask).otherwise("")).alias("out")),
                lambda acc: acc["out"],
            )
            return F.struct(F.greatest(at, stop).alias("at"), _let(F.substring(t, at + 1, F.greatest(stop - at, F.lit(0))), inner).alias("out"))

        return _let(F.array_max(F.transform(g, lambda x: x["e"])), cut)

    groups = F.transform(_groups(F.col(into)), lambda g: F.aggregate(g, none, merge))
    end = F.array_max(F.transform(F.col(into), lambda x: x["e"]))
    pieces = F.concat(_folded(groups, F.lit(0), clean, "string"), F.array(F.substring(t, end + 1, F.length(t))))
    return scan(docs, text, into).withColumn(text, F.when(F.size(into) > 0, F.array_join(pieces, "")).otherwise(t)).drop(into)
