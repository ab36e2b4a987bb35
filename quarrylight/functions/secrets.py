"""Leaked keys and passwords: finding, grading and masking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.match import contains_any, strip


def shannon_entropy(s: Column) -> Column:
    """Bits a character; 0 for the empty string, NULL for NULL."""
    chars = F.split(s, "")
    n = F.length(s)
    count = lambda c: F.size(F.filter(chars, lambda x: x == c))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.abs(F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda acc, c: acc + (count(c) / n) * F.log2(count(c) / n))))


def mask(s: Column) -> Column:
    """All stars up to 8 characters, else four at either end left."""
    return F.when(F.length(s) <= 8, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.substring(s, 1, 4), F.repeat(F.lit("*"), F.length(s) - 8), F.right(s, F.lit(4))))


def placeholder(value: Column, weak_hints: bool = True) -> Column:
    """Whether a value is an example rather than a secret; the weak hints are for free assignments only."""
    v = F.lower(strip(value))
    hints = rules.STRONG_PLACEHOLDER_HINTS + (rules.WEAK_PLACEHOLDER_HINTS if weak_hints else ())
    return (F.size(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))) <= 2) | contains_any(v, hints)


def effective_tier(tier: Column, value: Column) -> Column:
    """Tier of a match after its value was looked at; NULL drops it."""
    generic = (F.length(value) >= rules.GENERIC_MIN_LENGTH) & ~placeholder(value) & (shannon_entropy(value) >= rules.GENERIC_ENTROPY_MIN)
    return F.when(tier == "generic", F.when(generic, "medium")).when(~placeholder(value, False), tier)


def matches(text: Column) -> Column:
    """ARRAY<STRUCT<label, tier, value>> of all pattern matches."""

    def of(label: str, tier: str, pattern: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if tier == "generic" else 0))
        return F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), F.lit(tier).alias("tier"), v.alias("value")))

    return F.flatten(F.array(*(of(*p) for p in rules.SECRET_PATTERNS)))


def scan(pages: DataFrame, text: str = "body", url: str = "url", netloc: str = "netloc") -> DataFrame:
    """Findings (netloc, category, url, detail, kind) for the secrets of pages: masked, each once a page.

    Keys that are public by design are ``secret_info``. Raw values never leave the projection.
    """
    hit = pages.select(netloc, url, F.explode(F.array_distinct(matches(F.coalesce(F.col(text), F.lit(""))))).alias("m"))
    graded = hit.select(F.col(netloc).alias("netloc"), F.col(url).alias("url"), effective_tier(F.col("m.tier"), F.col("m.value")).alias("tier"), F.col("m.label").alias("label"), F.col("m.value").alias("value"))
    return graded.where("tier IS NOT NULL").select("netloc", F.when(F.col("tier") == "info", "secret_info").otherwise("secret").alias("category"), "url", mask(F.col("value")).alias("detail"),
                                                   F.concat("label", F.lit(" ("), "tier", F.lit(")")).alias("kind"))
