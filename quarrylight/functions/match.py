"""Small helpers to turn word lists into expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(x: str) -> str:
    """``x`` as a pattern that matches it, in Java and RE2 alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    An expression that is used several times, pushed down or put into a lambda would be computed
    for each use; bound as the variable of a one-element array it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, words) -> Column:
    """Whether ``c`` has one of ``words`` as a substring: byte searches, far cheaper than an alternation."""
    return let(c, lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)))


def ends_with_any(c: Column, ends) -> Column:
    return c.rlike("(?:" + "|".join(map(literal, ends)) + ")\\z")


def keywords(words) -> str:
    """Pattern for whole words or phrases: a letter or digit at an edge must not go on outside.

    The text must be in lower case. Alternatives are tried in the order of the list.
    """

    def edges(w: str) -> tuple[str, str]:
        return "(?<![a-z0-9])" if w[:1].isalnum() else "", "(?![a-z0-9])" if w[-1:].isalnum() else ""

    # neighbours with like edges share them: alternatives are tried at the beginnings of words only
    runs = [(k, list(own)) for k, own in groupby((w.strip() for w in words), edges)]
    parts = []
    for (left, right), own in runs:
        first = "(?=[" + "".join(literal(c) for c in sorted({w[0] for w in own})) + "])"
        parts.append(left + first + "(?:" + "|".join(map(literal, own)) + ")" + right)
    return "|".join(parts)


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))
