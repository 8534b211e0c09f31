"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space for strip, split and \s.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a pattern. Listed one by one, the low characters are a bit set, and the outer range
# turns most others away with one test; ranges alone cost about three times as much.
WHITESPACE = (
    r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Drop white space at both ends; unlike ``trim`` this covers tabs, newlines and Unicode spaces."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def normalized(text: Column) -> Column:
    """The form in which answers are compared."""
    return F.lower(strip(text))


def tokens(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.array_remove(F.split(F.lower(text), f"{WHITESPACE}+"), "")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two arrays without repeated elements: 1 when both are empty, 0 when one is."""
    both = F.size(left) + F.size(right)
    shared = bound(F.size(F.array_intersect(left, right)), lambda n: n / (both - n))
    return F.when(both == 0, F.lit(1.0)).otherwise(shared)


def word_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of the word sets of two texts."""
    sides = F.struct(F.array_distinct(tokens(left)).alias("left"), F.array_distinct(tokens(right)).alias("right"))
    return bound(sides, lambda s: jaccard(s["left"], s["right"]))


def topic(content: Column, width: int = 80) -> Column:
    """The short subject of a chunk, as templates mention it."""
    return strip(F.rtrim(F.substring(content, 1, width), F.lit(".")))


def stable_hash(*parts: Column | str) -> Column:
    """A 32-bit number that depends on the values alone: the same in every run and partitioning."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    joined = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")
