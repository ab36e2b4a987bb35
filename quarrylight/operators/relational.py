"""Relational operators of a crawl: first-seen, caps, set differences, counts, ranked selections.

Whatever "first" means is a column the caller names; nothing here relies on the order of arrival.
Firsts and caps are decided before the exchange as far as each partition can (partial aggregates,
group limits), so that a key with a third of all rows sends only a few of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import urls
from quarrylight.storage import cut

#: Rows of a global cap that one task still sorts.
ONE_TASK = 100_000


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each combination of ``keys`` (NULL is a value): the least by ``order``, then by the other columns.

    An aggregate, not a window: partitions combine before the exchange.
    """
    rest = [c for c in df.columns if c not in keys]
    whole = F.struct(*order, *(c for c in rest if c not in order))
    least = df.groupBy(*keys).agg(F.min(whole).alias("_first"))
    return least.select(*(F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns))


def cap_per_group(df: DataFrame, keys: list[str], order: list[str | Column], most: int, rank: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group, with their place as column ``rank`` if named; 0 caps nothing.

    Ties fall by the order's last column, which should be unique.
    """
    if not most:
        return df
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(rank or "_rank", place).where(F.col(rank or "_rank") <= most)
    return kept if rank else kept.drop("_rank")


def skipped_by_cap(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, skipped): rows a cap leaves out, for groups over it."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select(*keys, (F.col("n") - most).alias("skipped"))


def global_cap(df: DataFrame, order: list[str | Column], most: int, used: int = 0) -> DataFrame:
    """The first ``most - used`` rows of all; 0 caps nothing.

    A limit is one task's work, so a cap above ``ONE_TASK`` rows goes by ranges: the table is
    written range by range, ranges before the cap are kept whole, and only the range it falls
    in is cut.
    """
    if not most:
        return df
    left = max(0, most - used)
    if left <= ONE_TASK:
        return df.orderBy(*order).limit(left)
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "cap")
    whole: list[int] = []
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("_range").count().collect()):  # a row a shuffle partition
        if n > left:
            edge = ranged.where(F.col("_range") == part).orderBy(*order).limit(left)
            return ranged.where(F.col("_range").isin(whole)).unionByName(edge).drop("_range")
        whole.append(part)
        left -= n
    return ranged.drop("_range")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among ``seen``."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def in_scope(df: DataFrame, url: str, sites: DataFrame, allow_external: bool = False) -> DataFrame:
    """Rows whose address belongs to one of ``sites`` (hosts, in any spelling)."""
    if allow_external:
        return df
    known = sites.select(urls.clean_host(F.col(sites.columns[0])).alias("_site")).distinct()
    return df.withColumn("_site", urls.site_key(F.col(url))).join(known, "_site", "left_semi").drop("_site")


def below_domain(df: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is, or is below, one of ``domains``.

    Each distinct host is met with the list once, by an equality join on its suffixes; the rows
    then join by host. Lists and tables of any length do.
    """
    known = domains.select(F.lower(F.col(domains.columns[0])).alias("_suffix")).distinct()
    parts = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = df.withColumn("_host", urls.site_form(F.col(host)))
    hits = keyed.where("_host IS NOT NULL").select("_host").distinct().select("_host", F.explode(suffixes).alias("_suffix")).join(known, "_suffix", "left_semi")
    return keyed.join(hits.select("_host").distinct(), "_host", "left_semi").drop("_host")


def numbered_names(df: DataFrame, folder: str, name: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``df`` with ``file_name``: the first of a name in a folder keeps it, later ones get ``-2``, ``-3``, ... before the ending.

    No two rows get one name, and none a name in ``taken`` (same two columns): a number that makes
    a name some row has by nature, or that is taken, is passed over. Candidates are the numbers up
    to a name's rows and taken names, met with the names in use by an equality join. NULL is a
    folder, and a name, of its own.
    """
    rows = df.withColumn("_rank", F.row_number().over(Window.partitionBy(folder, name).orderBy(*order)))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    base = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(suffix))
    # names in use: of nature (each stays with the first row of it) and taken ones
    natural = df.select(F.col(folder).alias("_f"), F.col(name).alias("_made")).distinct()
    used = natural if taken is None else natural.unionByName(taken.select(F.col(folder).alias("_f"), F.col(name).alias("_made"))).distinct()
    held = None if taken is None else taken.select(folder, name).distinct().withColumn("_held", F.lit(1))
    sizes = df.groupBy(folder, name).agg(F.count(F.lit(1)).alias("_n"))
    if held is not None:
        sizes = sizes.join(held, (sizes[folder].eqNullSafe(held[folder])) & (sizes[name].eqNullSafe(held[name])), "left").select(sizes[folder], sizes[name], "_n", F.coalesce("_held", F.lit(0)).alias("_held"))
    else:
        sizes = sizes.withColumn("_held", F.lit(0))
    # numbers in use that look like numbered forms of a name: so many candidates more are enough
    stem = F.regexp_replace("_made", r"-\d+(?=(?:\.[^.]*)?$)", "")
    forms = used.where(stem != F.col("_made")).groupBy(F.col("_f"), stem.alias("_s")).agg(F.count(F.lit(1)).alias("_forms"))
    sizes = sizes.join(forms, sizes[folder].eqNullSafe(F.col("_f")) & (sizes[name] == F.col("_s")), "left").select(folder, name, "_n", "_held", F.coalesce("_forms", F.lit(0)).alias("_forms"))
    need = F.col("_n") + F.col("_held") + F.col("_forms")
    made = sizes.where((need > 1) & F.col(name).isNotNull()).select(folder, name, "_held", F.explode(F.sequence(F.lit(2), (need + 1).cast("int"))).alias("_k"))
    made = made.withColumn("_made", F.concat(base, F.lit("-"), F.col("_k").cast("string"), suffix))
    free = made.join(used, made[folder].eqNullSafe(used["_f"]) & (made["_made"] == used["_made"]), "left_anti")
    # the n-th free number goes to the n-th row that needs one
    turn = F.row_number().over(Window.partitionBy(folder, name).orderBy("_k")) + 1 - F.col("_held")
    free = free.select(F.col(folder).alias("_f"), F.col(name).alias("_s"), turn.alias("_turn"), "_made")
    out = rows.join(free, rows[folder].eqNullSafe(F.col("_f")) & (rows[name] == F.col("_s")) & (rows["_rank"] == F.col("_turn")), "left")
    return out.withColumn("file_name", F.coalesce("_made", name)).select(*df.columns, "file_name")


def mark_duplicates(df: DataFrame, key: str, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """``df`` with ``duplicate``: whether its key stands earlier in the order, or among ``seen``."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if seen is not None:
        out = out.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_seen", F.lit(None).cast("boolean"))
    return out.withColumn("duplicate", (F.col("_rank") > 1) | F.coalesce("_seen", F.lit(False))).drop("_rank", "_seen")


# --- counts -------------------------------------------------------------------------------------
def state_counts(frontier: DataFrame) -> DataFrame:
    """(state, n) for the states 0, 1 and 2, zeros included."""
    states = frontier.sparkSession.range(3).select(F.col("id").cast("int").alias("state"))
    got = frontier.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.join(got, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def pending_and_active(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count_if(F.col("state") == 0).alias("pending"), F.count_if(F.col("state") == 1).alias("active"))


def category_counts(findings: DataFrame) -> DataFrame:
    """(netloc, category, n) of distinct findings."""
    return distinct_findings(findings).groupBy("netloc", "category").agg(F.count(F.lit(1)).alias("n"))


def category_summary(findings: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """One row a site, one column a category."""
    return category_counts(findings).groupBy("netloc").pivot("category", list(categories)).agg(F.sum("n")).na.fill(0)


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Findings without repeats (whatever their ids); NULLs are equal."""
    return findings.select("netloc", "category", "url", "detail", "found_on", "kind").distinct()


def findings_of(findings: DataFrame, netloc: str, category: str) -> DataFrame:
    """Distinct findings of a site and category by address."""
    rows = findings.where((F.col("netloc") == netloc) & (F.col("category") == category)).select("url", "detail", "found_on", "kind").distinct()
    return rows.orderBy("url", "detail", "found_on", "kind")


def site_counters(events: DataFrame) -> DataFrame:
    """Counters a site from event rows (netloc, event)."""
    names = ("pages_crawled", "robots_blocked", "pattern_skipped", "query_skipped")
    return events.groupBy("netloc").agg(*(F.count_if(F.col("event") == n).alias(n) for n in names))


def sites_with_data(stats: DataFrame, findings: DataFrame) -> DataFrame:
    """Sites with statistics or findings, in order."""
    return stats.select("netloc").union(findings.where("netloc IS NOT NULL").select("netloc")).distinct().orderBy("netloc")


def stats_and_findings(stats: DataFrame, findings: DataFrame) -> DataFrame:
    """Full outer join of statistics and counts of findings, a row a site."""
    counts = findings.where("netloc IS NOT NULL").groupBy(urls.clean_host(F.col("netloc")).alias("netloc")).agg(F.count(F.lit(1)).alias("findings"))
    own = stats.select(urls.clean_host(F.col("netloc")).alias("netloc"), "pages_crawled", "robots_blocked", "pattern_skipped", "query_skipped")
    joined = own.join(counts, "netloc", "full_outer")
    return joined.select("netloc", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages_crawled", "robots_blocked", "pattern_skipped", "query_skipped", "findings")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- finds --------------------------------------------------------------------------------------
def arrival(finds: DataFrame) -> list[Column]:
    """The order in which finds came: their number, or where the format has none, time and then the text."""
    if "find_id" in finds.columns:
        return [F.col("find_id")]
    return [F.coalesce(c, F.lit("")) for c in ("ts", "domain", "kind", "text") if c in finds.columns]


def hall_of_fame(finds: DataFrame, most: int = 40) -> DataFrame:
    """The best finds: by score, then the earliest; a find without score comes last."""
    return finds.orderBy(F.coalesce("score", F.lit(0)).desc(), F.coalesce("ts", F.lit("")), *arrival(finds)).limit(most)


def most_recent(finds: DataFrame, most: int = 80) -> DataFrame:
    return finds.orderBy(*(c.desc() for c in arrival(finds))).limit(most)


def last_per_kind(finds: DataFrame, most: int = 120) -> DataFrame:
    return cap_per_group(finds.where("kind IS NOT NULL"), ["kind"], [c.desc() for c in arrival(finds)], most)


# --- report rows --------------------------------------------------------------------------------
def search_rows(rows: DataFrame, needle: str = "", categories: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the chosen categories (none: all) that have the needle, in any case, in their cells."""
    if categories:
        rows = rows.where(F.col("category").isin(*categories))
    needle = needle.strip().lower()
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("category", "detail", "url", "found_on"))))
    return rows.where(hay.contains(needle)) if needle else rows


def sorted_rows(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column of mixed cells: numbers by value first, then texts whatever their case."""
    c = F.col(column)
    number = c.try_cast("double")
    keys = [number.isNull(), number, F.lower(c), c]
    return rows.orderBy(*(k.desc() if descending else k.asc() for k in keys))
