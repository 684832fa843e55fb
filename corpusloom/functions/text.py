"""Text expressions with the white space rules of the corpus format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WHITESPACE

#: A Java character class of all white space code points.
SPACE_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, where the body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column | str) -> Column:
    """Without white space at both ends; null stays null."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITESPACE))


def words(text: Column | str) -> Column:
    """Pieces between white space; no empty pieces, none for an empty text."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items, joined by spaces; none if there are fewer."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, n), " "))).otherwise(F.array().cast("array<string>"))


def repetition_rate(text: Column | str, n: int = 8) -> Column:
    """Share of repeated n-grams of words: 1 - distinct / all; 0 for texts of at most n words, null for null."""
    return let(words(text), lambda w: F.when(w.isNull(), F.lit(None).cast("double")).when(F.size(w) <= n, F.lit(0.0)).otherwise(let(ngrams(w, n), lambda g: 1 - F.size(F.array_distinct(g)) / F.greatest(F.size(g), F.lit(1)))))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def duration(seconds: Column) -> Column:
    """Seconds as 1h02m03s, 2m03s or 3s."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def bar(value: Column, top: Column, width: int = 40) -> Column:
    """A bar of # whose length is the value's share of the top."""
    return F.when(top > 0, F.repeat(F.lit("#"), F.floor(value * width / top).cast("int"))).otherwise("")
