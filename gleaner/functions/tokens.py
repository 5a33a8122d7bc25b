"""From a message to its terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What parts words, and words that always give way to an asterisk.
DELIMITERS = r"""\\[b0rnt]|[\x08\r\n\t"\\',;\[\]<>{}=()|:&?+/]"""
STOP_WORDS = "- ; , . # $ % & ' ( ) = ~ ^ | { } : + < > [ ] a an the".split()
MAX_DIGITS = 3
STAR = "*"


def _in(word: Column, words) -> Column:
    return word.isin(list(words)) if words else F.lit(False)


def _parted(message: Column) -> Column:
    """The words of a message, with empty ones between delimiters that meet."""
    return F.split(F.regexp_replace(message, DELIMITERS, " "), " ")


def words(message: Column) -> Column:
    return F.array_remove(_parted(message), "")


def _normal(message: Column, keywords, ignorewords) -> Column:
    """For each word (keyword, raw, its lower-cased form without one trailing full stop), stars among them.

    One step for each array, so that no step computes what the one before has found.
    """
    starred = F.transform(
        words(message),
        lambda w: F.when(_in(w, ignorewords) | (_in(w, STOP_WORDS) & ~_in(w, keywords)), STAR).otherwise(w),
    )
    low = F.transform(starred, lambda w: F.struct(_in(w, keywords).alias("k"), w.alias("w"), F.lower(w).alias("t")))
    dotted = lambda x: x["t"].endswith(".") & (F.octet_length(x["t"]) > 1)
    cut = lambda x: F.when(dotted(x), F.substr(x["t"], F.lit(1), F.length(x["t"]) - 1)).otherwise(x["t"])
    return F.transform(low, lambda x: F.struct(x["k"].alias("k"), x["w"].alias("w"), cut(x).alias("t")))


def _term(w: Column, ignorewords) -> Column:
    """A word's term where no word is a keyword: lower-cased without one trailing full stop, or a star."""
    dotted = w.endswith(".") & (F.octet_length(w) > 1)
    cut = F.substr(F.lower(w), F.lit(1), F.length(F.lower(w)) - 1)
    starred = w.isin([*STOP_WORDS, *(x for x in ignorewords if x)])
    return F.when(starred, STAR).when(dotted, cut).otherwise(F.lower(w))


def _long_enough(t: Column) -> Column:
    """Stars, and terms of over two bytes that are no integers of over MAX_DIGITS digits."""
    n = F.octet_length(t)
    integer = (n > MAX_DIGITS) & ~t.startswith("0") & t.rlike(r"^\p{Nd}+$")
    return (t == STAR) | ((n > 2) & ~integer)


def _stays(x: Column) -> Column:
    return x["k"] | _long_enough(x["t"])


def tokens(message: Column, keywords=(), ignorewords=()) -> Column:
    """The terms of a message, in order.

    Words to ignore become asterisks before all else; keywords are exempt from stop
    words, from the length gate and from the removal of long integers.
    """
    if not keywords:
        return F.filter(F.transform(_parted(message), lambda w: _term(w, ignorewords)), lambda t: _long_enough(t))
    return F.transform(F.filter(_normal(message, keywords, ignorewords), _stays), lambda x: x["t"])


def excluded(message: Column, keywords=(), ignorewords=()) -> Column:
    """Words that leave no term behind: dropped or starred."""
    gone = F.filter(_normal(message, keywords, ignorewords), lambda x: ~_stays(x) & (x["w"] != STAR))
    plain = F.array_intersect(words(message), F.array(*[F.lit(w) for w in (*STOP_WORDS, *ignorewords)]))
    return F.array_distinct(F.concat(F.transform(gone, lambda x: x["w"]), plain))
