"""Text columns: white space, scripts, numerals, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges that count as CJK (punctuation and kana, ideographs, compatibility, half and full width).
CJK = "　-ヿ㐀-䶿一-鿿豈-﫿＀-￯"
# Punctuation left out of the CJK share.
CJK_IGNORED = "、。，．・「」『』（）()［］\\[\\]【】!?！？:：;；,.'\"\\-—…"
# Common characters that are neither blank nor listed there; runs that begin with one are ruled out first, as the others are compared one by one.
NEVER_IGNORED = "a-zぁ-ヺ一-鿿"
CIRCLED_ONE = ord("①")
# Numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
KANJI_DIGITS = "〇一二三四五六七八九"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def collapse_cjk_space(text: Column) -> Column:
    """Drop blanks between two CJK characters, in one consuming pass."""
    return F.regexp_replace(text, f"([{CJK}])[ \\t\\u3000]+([{CJK}])", "$1$2")


def strip_inline_html(text: Column) -> Column:
    """``<br>`` becomes a line break; ``<sup>`` tags go, their content stays."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"(?i)</?sup\b[^>]*>", "")


def strip(text: Column) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _without_ignored(text: Column) -> Column:
    return F.regexp_replace(text, f"(?![{NEVER_IGNORED}])[\\s\\x85\\p{{Z}}{CJK_IGNORED}]+", "")


def _cjk_length(body: Column) -> Column:
    return F.length(F.regexp_replace(body, f"[^{CJK}]+", ""))


def cjk_share(text: Column) -> Column:
    """CJK characters among those that are neither blank nor listed punctuation."""
    share = lambda body: F.coalesce(F.try_divide(_cjk_length(body).cast("double"), F.length(body)), F.lit(0.0))
    return F.get(F.transform(F.array(_without_ignored(text)), share), F.lit(0))


def mostly_cjk(text: Column, threshold: float = 0.6) -> Column:
    # The text and its sizes are elements of arrays, so that each is made once, whatever refers to it.  A long text with
    # more than 20 such characters is read as far as the 21st.
    counted = f"[{CJK}&&[^\\s\\x85\\p{{Z}}{CJK_IGNORED}]]"
    other = f"[[^{CJK}][\\s\\x85\\p{{Z}}{CJK_IGNORED}]]"
    many = f"^(?:{other}*+{counted}){{21}}"

    def of_sizes(t: Column) -> Column:
        sizes = F.transform(F.array(_without_ignored(t)), lambda b: F.struct(F.length(b).alias("size"), _cjk_length(b).alias("n")))
        said = F.transform(
            sizes,
            lambda s: F.when(t.isNull() | (s["size"] == 0), False)
            .when((s["size"] <= 10) & (s["n"] >= 1), True)
            .otherwise(s["n"] / s["size"] >= threshold),
        )
        return F.get(said, F.lit(0))

    return F.get(F.transform(F.array(text), lambda t: F.when((F.length(t) > 100) & t.rlike(many), True).otherwise(of_sizes(t))), F.lit(0))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH_DIGITS, "0123456789")


def roman_value(text: Column) -> Column:
    """Value of an ASCII roman numeral; null if it is none."""
    value = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    signs = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        v = value[c]
        return F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))

    return F.when(text.rlike("^[IVXLCDMivxlcdm]+$"), F.aggregate(F.reverse(signs), start, step, lambda acc: acc["sum"]))


def kanji_value(text: Column) -> Column:
    """Value of a kanji numeral below 10000; null if it is none."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"))

    def step(acc: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
        digit = F.position(c, F.lit(KANJI_DIGITS)) - 1
        more = F.greatest(acc["digit"], F.lit(1)) * unit
        return F.struct((acc["sum"] + F.coalesce(more, F.lit(0))).alias("sum"), F.when(unit.isNotNull(), 0).otherwise(acc["digit"] * 10 + digit).alias("digit"))

    signs = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.rlike(f"^[{KANJI_DIGITS}十百千]+$"), F.aggregate(signs, start, step, lambda acc: acc["sum"] + acc["digit"]))


def prefix_number(text: Column) -> Column:
    """Number of a heading prefix: Arabic (also full width), circled, roman or kanji."""
    plain = ascii_digits(text)
    return F.coalesce(
        F.regexp_extract(plain, r"(\d+)", 1).try_cast("int"),
        F.when(text.rlike("[①-⑳]"), F.ascii(F.regexp_extract(text, "([①-⑳])", 1)) - CIRCLED_ONE + 1),
        roman_value(F.regexp_replace(text, r"[^A-Za-z]", "")),
        kanji_value(F.regexp_replace(text, f"[^{KANJI_DIGITS}十百千]", "")),
    )


def split_keywords(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[、,/／;；|\s]+"), lambda x: x != "")


def row_key(*cols: Column) -> Column:
    """A 60-bit key of the columns' texts that other engines can compute too."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\-]", "_")
