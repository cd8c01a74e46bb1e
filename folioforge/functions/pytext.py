"""Text columns with the white space, line and word rules of the document model.

Lines end at any of the Unicode line boundaries, words are parted by any Unicode white space, and
trimming removes that same white space. A null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space but the blank: signs up to U+00FF one by one and the others behind one range, two tests a sign where ``SPACE`` takes a dozen.
ODD_SPACE = r"[\t\n\x{b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
ODD_END = r"[\x{b}\f\r\x{1c}\x{1d}\x{1e}\x{85}\x{2028}-\x{2029}]"
LINE_END = r"(?:\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col(c), pattern, by)


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def rstrip(c) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def lines(c) -> Column:
    """Array of lines without their ends; an end at the end of the text opens no line."""

    def cut(c):
        # splits at one sign are not made by the pattern engine
        return F.when(c.rlike(ODD_END), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))

    kept = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.get(F.transform(F.transform(F.array(col(c)), cut), kept), F.lit(0))


def words(c) -> Column:
    """The words of a text; a split at one sign is not made by the pattern engine, and the empty pieces go."""
    even = bound(F.replace(col(c), F.lit("\n"), F.lit(" ")), lambda t: F.when(t.rlike(ODD_SPACE), sub(t, ODD_SPACE, " ")).otherwise(t))
    return F.array_remove(F.split(even, " ", -1), "")


def spaced(c) -> Column:
    """All white space inside the text as one space and none around it."""
    return F.array_join(words(c), " ")


def n_words(c) -> Column:
    return F.array_size(words(c))


def any_of(patterns) -> str:
    """One pattern for a list of whole-line patterns, case-insensitive."""
    return "(?iuU)" + "|".join(f"(?:{p})" for p in patterns)


def joined(items: Column, sep: str) -> Column:
    return F.array_join(items, sep)


def rewritten(c, pattern: str, replace) -> Column:
    """Each match of a pattern with one group replaced by ``replace(group, match)``."""
    c = col(c)
    whole = f"(?:{pattern})"
    gaps = F.split(c, whole, -1)
    inner = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    full = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("g"), inner.alias("i"), full.alias("f"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.when(x["f"].isNull(), "").otherwise(replace(x["i"], x["f"])))), "")


def bound(value: Column, f) -> Column:
    """f(value): the value is made once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def named(value: Column, f) -> Column:
    """f(value) where f gives an array: the value is made once, however often f uses it."""
    return F.flatten(F.transform(F.array(value), f))
