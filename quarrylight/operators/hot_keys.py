"""Per-key results where a few keys hold most rows: eager aggregation below the join.

Rows of a hot key never meet in one task as rows. They are deduplicated under a hash of the whole
row, which spreads any key evenly; counted per key within each partition before they move; and
joined only as *states*, one row a key and side, whose counts and sums combine algebraically.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import urls


@dataclass(frozen=True)
class Measure:
    """A sum over the joined rows of ``value``, a column of the ``side`` ("left" or "right").

    NULL values count as absent, as in SQL; a side without a value gives NULL.
    """

    name: str
    side: str
    value: Column


def row_identity(*columns: Column) -> Column:
    """128 hash bits of a row, in which NULL equals NULL and differs from every value."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(11), *parts).alias("a"), F.xxhash64(F.lit(29), *parts).alias("b"))


def distinct_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` once for each distinct row in ``keys`` and ``columns``.

    The exchange goes by the row's hash, so a key with a third of all rows is spread over all
    tasks; repeats of one row are combined before it. Only keys and 16 bytes a row move.
    """
    return (df.select(*keys, row_identity(*(F.col(c) for c in columns)).alias("_row"))
            .select(*keys, F.col("_row.a").alias("_a"), F.col("_row.b").alias("_b"))
            .groupBy("_a", "_b", *keys).agg(F.lit(1).alias("_one")).select(*keys))


def _state(df: DataFrame, keys: list[str], on: list[str], measures: list[Measure], side: str) -> DataFrame:
    own = [m for m in measures if m.side == side]
    sums = [F.sum(m.value).alias(f"_s{measures.index(m)}") for m in own]
    return df.groupBy(*dict.fromkeys([*on, *keys])).agg(F.count(F.lit(1)).alias(f"_n_{side}"), *sums)


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: list[str], group: list[str], measures: list[Measure] = (), how: str = "inner") -> DataFrame:
    """``left JOIN right USING (on) GROUP BY group`` without ever joining rows.

    Both inputs are aggregated by the join key first (the left one by the grouping columns too,
    which must be its own); the joined state of a key has ``n_left * n_right`` rows, and a sum over
    one side counts as often as the other side has rows. Result: ``group``, ``joined_rows``
    (0 on the right for an unmatched key of a left join), ``left_rows`` and the measures. NULL
    keys match nothing. Empty inputs give an empty result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    a, b = _state(left, group, on, measures, "left"), _state(right, [], on, measures, "right")
    states = a.join(b, on, how)
    other = {"left": F.coalesce(F.col("_n_right"), F.lit(0 if how == "inner" else 1)), "right": F.col("_n_left")}
    sums = [F.sum(F.col(f"_s{i}") * other[m.side]).alias(m.name) for i, m in enumerate(measures)]
    matched = F.coalesce(F.col("_n_right"), F.lit(0))
    return states.groupBy(*group).agg(F.sum(F.col("_n_left") * matched).alias("joined_rows"), F.sum("_n_left").alias("left_rows"), *sums)


def clean_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``netloc`` in site form and ``category`` trimmed and lower-cased; rows without netloc go."""
    return (findings.where(F.col("netloc").isNotNull())
            .select(urls.clean_host(F.col("netloc")).alias("netloc"),
                    F.lower(F.regexp_replace("category", r"^\s+|\s+$", "")).alias("category"),
                    "url", "detail", "found_on", "kind"))


def pair_rollup(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """Per (netloc, category): distinct findings, their share of all, and the site's crawl figures.

    ``pages`` is the sum of the site's pages_crawled over its rows in ``sites``; a site without a
    row keeps its findings and has NULL pages.
    """
    facts = distinct_rows(clean_findings(findings), ["netloc", "category"], ["netloc", "category", "url", "detail", "found_on", "kind"])
    at_site = sites.select(urls.clean_host(F.col("netloc")).alias("netloc"), "pages_crawled")
    pairs = eager_join_aggregate(facts, at_site, ["netloc"], ["netloc", "category"],
                                 [Measure("page_findings", "right", F.col("pages_crawled"))], how="left")
    # one row: the sum of the pairs' states
    whole = pairs.agg(F.sum("left_rows").alias("_all")).withColumn("_k", F.lit(1))
    return (pairs.withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k")
            .select("netloc", "category", F.col("left_rows").cast("long").alias("findings"),
                    F.col("_all").cast("long").alias("all_findings"),
                    (F.col("page_findings") / F.col("left_rows")).cast("long").alias("pages")))


def hot_pairs(findings: DataFrame, sites: DataFrame, percent: int = 1) -> DataFrame:
    """(netloc, category) pairs that hold at least ``percent`` % of all distinct findings."""
    pairs = pair_rollup(findings, sites)
    return pairs.where(F.col("findings") * 100 >= F.col("all_findings") * percent).select("netloc", "category")
