"""Words: maximal runs of letters or digits of the lower-cased text, in any alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words, for Java's and RE2's regular expressions alike.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for NULL, empty and wordless text.

    A split costs less than matching each word; the one empty string it leaves at either end is
    cut off by trimming the separators first.
    """
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")
    return F.filter(F.split(body, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of ``text``, 0 for NULL."""
    return F.size(words(text))
