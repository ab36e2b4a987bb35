"""robots.txt: rules with wildcards as rows and joins, and the standard parser as a function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import urls
from quarrylight.functions.match import strip


def pattern_regex(pattern: Column) -> Column:
    """Pattern of a rule as a regular expression: ``*`` is any run, a final ``$`` the end, the rest literal."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit(")"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def parse(files: DataFrame, root: str = "root", body: str = "body") -> DataFrame:
    """(root, ord, pattern, regex, allow, specificity): the rules for all agents.

    A user-agent line starts a group; of several in a row the last one decides whose it is. Empty
    values and lines without a colon are no rules; a NULL or empty file has none.
    """
    lines = files.where(F.col(body).isNotNull()).select(F.col(root).alias("root"), F.posexplode(F.split(F.col(body), r"\r\n|\n|\r")).alias("ord", "line"))
    lines = lines.withColumn("line", strip(F.substring_index("line", "#", 1))).where(F.col("line").contains(":"))
    field = F.lower(strip(F.substring_index("line", ":", 1)))
    value = strip(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("root", "ord", field.alias("field"), value.alias("value"))
    so_far = Window.partitionBy("root").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(so_far)
    rules = lines.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("root", "ord", F.col("value").alias("pattern"), pattern_regex(F.col("value")).alias("regex"), (F.col("field") == "allow").alias("allow"), F.length("value").alias("specificity"))


def request_path(url: Column) -> Column:
    """What rules are held against: path, ``/`` if empty, with the query."""
    p, q = urls.path(url), urls.query(url)
    return F.concat(F.when(p == "", F.lit("/")).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``allowed``: the longest matching rule of the page's root decides, the first of equals; no rule allows.

    Rules of a root are gathered into one sorted array, which a join by root brings to its pages:
    no page is multiplied by rules, and a root with many pages is split like any skewed key.
    """
    root = F.concat(urls.scheme(F.col(url)), F.lit("://"), urls.netloc(F.col(url)))
    by_root = rules.groupBy(F.col("root").alias("_root")).agg(F.sort_array(F.collect_list(F.struct((-F.col("specificity")).alias("s"), "ord", "regex", "allow"))).alias("_rules"))
    joined = pages.withColumn("_root", root).withColumn("_path", request_path(F.col(url))).join(by_root, "_root", "left")
    first = F.get(F.filter("_rules", lambda r: F.regexp_like(F.col("_path"), r["regex"])), F.lit(0))
    return joined.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_root", "_path", "_rules")


def standard_allowed(body: Column, url: Column, agent: str = "*") -> Column:
    """Verdict of the standard library's parser (no wildcards) on an address; no file allows."""

    @F.pandas_udf("boolean")
    def verdict(bodies: pd.Series, addresses: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        known: dict[str, RobotFileParser] = {}
        out = []
        for b, u in zip(bodies, addresses):
            if b is None or u is None:
                out.append(True)
                continue
            if b not in known:
                known[b] = RobotFileParser()
                known[b].parse(b.splitlines())
            out.append(known[b].can_fetch(agent, u))
        return pd.Series(out)

    return verdict(body, url)
