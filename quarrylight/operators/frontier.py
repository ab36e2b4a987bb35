"""The frontier: a fix-point over waves of addresses, with caps, priorities and resumption.

A wave is a table. Its pages pass the robots gate, the cap a host and the budget of pages and are
fetched; its resources and probes are checked for their status. Responses give references, which
pass the gates of scheme, scope and depth; what the frontier has not seen passes the caps a path
prefix and a path, and is the next wave. Counts of a wave (what filled a cap, what was refused) are
a table of that wave, so that caps hold over the whole crawl, interrupted or not. Each wave ends in
shared storage under a manifest that is written last: a run that dies goes on from its last whole
wave, and no lineage grows across waves.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import urls
from quarrylight.operators import relational as R
from quarrylight.storage import cut, scratch

FRONTIER = "urlhash string, kind string, url string, source string, depth int, seq long, priority int, wave int"


#: Columns of the frontier by name, and the order in which addresses are taken.
COLUMNS = [c.split()[0] for c in FRONTIER.split(", ")]
ORDER = ["priority", "depth", "seq", "urlhash"]
#: Counters of a wave: what a bucket admitted and refused.
COUNTERS = "cap string, site string, bucket string, used long, skipped long"


@dataclass(frozen=True)
class Limits:
    """Bounds of a crawl; 0 is none.

    ``max_rows`` bounds the addresses discovered, ``max_pages`` the pages fetched, ``max_per_host``
    the pages fetched of a host. ``count_occurrences`` counts repeats of an address, seen ones
    included, against the caps of prefixes and queries; without it they count different new
    addresses. ``form`` is the spelling by which addresses are one: ``canonical`` or ``roaming``.
    ``home_first`` fetches the front page of a host next after the first page met of it.
    """

    max_rows: int = 0
    max_pages: int = 0
    max_depth: int = 0
    max_per_prefix: int = 0
    prefix_depth: int = 1
    max_query_variants: int = 0
    max_per_host: int = 0
    wave_size: int = 0
    allow_external: bool = False
    count_occurrences: bool = False
    form: str = "canonical"
    home_first: bool = False


def _form(limits: Limits):
    return urls.roaming_form if limits.form == "roaming" else urls.canonical


def seed_rows(spark: SparkSession, seeds: list[str], limits: Limits = Limits()) -> DataFrame:
    """Seeds as frontier rows of depth 0 and priority 0."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(dict.fromkeys(seeds))], "seq long, s string")
    url = _form(limits)(urls.with_scheme(F.col("s")))
    rows = rows.select(urls.url_hash(url).alias("urlhash"), F.lit("page").alias("kind"), url.alias("url"), url.alias("source"), F.lit(0).alias("depth"), "seq", F.lit(0).alias("priority"), F.lit(0).alias("wave"))
    return R.first_per_key(rows, ["urlhash"], ["seq"]).select(*COLUMNS)


def probe_rows(spark: SparkSession, roots: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Roots by a fixed list of paths, as rows of the frontier; the list goes along as one array, no join."""
    each = roots.select(F.explode(F.transform(F.array(*map(F.lit, paths)), lambda p: F.struct(F.col(roots.columns[0]).alias("root"), p.alias("path")))).alias("p"))
    url = F.concat("p.root", "p.path")
    return each.select(url.alias("url"), F.col("p.root").alias("source"), F.lit("probe").alias("kind")).distinct()


def candidates(links: DataFrame, limits: Limits, scope: DataFrame | None, seen: DataFrame | None = None, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """References (url, target, kind, depth, seq) that pass the gates, as one row for each address, and the counters of the caps.

    Of several references to an address in one wave a page goes before a resource, then the
    first; its depth is that of its first discovery. Addresses in ``seen`` (urlhash) are left out
    before they can fill a cap, unless occurrences are counted. ``used`` are the counters of
    earlier waves; a bucket admits what they leave of its cap. Counters are None without caps.
    """
    rows = links.where("target IS NOT NULL").withColumn("c", _form(limits)(F.col("target")))
    if limits.max_depth:
        rows = rows.where((F.col("depth") <= limits.max_depth) | (F.col("kind") != "page"))
    page = F.col("kind") == "page"
    if scope is not None and not limits.allow_external:
        inside = R.in_scope(rows.where(page), "c", scope)
        rows = inside.unionByName(rows.where(~page))
    rows = rows.withColumn("urlhash", urls.url_hash(F.col("c"))).withColumn("_resource", ~page)
    own = ["urlhash", "_resource", "seq", "kind", "c", "url", "depth"]
    once = lambda df: R.first_per_key(df.select(*own), ["urlhash"], ["_resource", "seq"])
    new = lambda df: df if seen is None else R.unseen(df, seen, ["urlhash"])
    capped = limits.max_per_prefix or limits.max_query_variants
    rows = rows.select(*own) if limits.count_occurrences else new(once(rows))
    counters = None
    if capped:
        rows = cut(rows, "crawl-candidates")  # read by the counts and by the caps
        asked = urls.query(F.col("c")) != ""
        for cap, most, bucket, counted in (("prefix", limits.max_per_prefix, urls.path_prefix(F.col("c"), limits.prefix_depth), F.lit(True)), ("query", limits.max_query_variants, urls.raw_path(F.col("c")), asked)):
            if not most:
                continue
            # a resource, a front page (prefixes) and an address without query (variants) fill no bucket
            rows = rows.withColumn("_site", urls.site_key(F.col("c"))).withColumn("_bucket", F.when(page & counted & ((bucket != "") | F.lit(cap == "query")), bucket))
            free, bound = rows.where("_bucket IS NULL"), rows.where("_bucket IS NOT NULL")
            kept, counts = _capped(bound, most, cap, used)
            counters = counts if counters is None else counters.unionByName(counts)
            rows = free.unionByName(kept).drop("_site", "_bucket")
    if limits.count_occurrences:
        rows = new(once(rows))
    return rows.select("urlhash", "kind", F.col("c").alias("url"), F.col("url").alias("source"), "depth", "seq", urls.link_priority(F.col("c")).alias("priority")), counters


def _capped(rows: DataFrame, most: int, cap: str, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What a cap admits of rows with ``_site`` and ``_bucket``, and its counters.

    Ranks are cut at the cap before the exchange and before earlier counts are joined, so that a
    bucket with a third of all rows sends ``most`` of them and no more.
    """
    totals = rows.groupBy("_site", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    kept = R.cap_per_group(rows, ["_site", "_bucket"], ["seq", "urlhash"], most, rank="_place")
    before = F.lit(0)
    if used is not None:
        earlier = used.where(F.col("cap") == cap).groupBy(F.col("site").alias("_site"), F.col("bucket").alias("_bucket")).agg(F.sum("used").alias("_used"))
        kept, totals = kept.join(earlier, ["_site", "_bucket"], "left"), totals.join(earlier, ["_site", "_bucket"], "left")
        before = F.coalesce("_used", F.lit(0))
    kept = kept.where(F.col("_place") + before <= most).drop("_place", "_used")
    admitted = F.least(F.col("_n"), F.greatest(F.lit(most) - before, F.lit(0)))
    counts = totals.select(F.lit(cap).alias("cap"), F.col("_site").alias("site"), F.col("_bucket").alias("bucket"), admitted.cast("long").alias("used"), (F.col("_n") - admitted).cast("long").alias("skipped"))
    return kept, counts


class Crawl:
    """A resumable crawl.

    ``fetch``: wave -> responses (any table with ``url``); ``expand``: (responses, wave) -> (url,
    target, kind) and, for the order of discovery, ``ord``; ``gate``: (crawl, pages) -> pages with
    ``allowed``; ``check``: resources and probes -> their status (any table with ``url``).
    """

    def __init__(self, spark: SparkSession, seeds: list[str], fetch: Callable[[DataFrame], DataFrame], expand: Callable[[DataFrame, DataFrame], DataFrame], limits: Limits = Limits(), path: str | None = None, fresh: bool = False,
                 gate: Callable[[Crawl, DataFrame], DataFrame] | None = None, check: Callable[[DataFrame], DataFrame] | None = None, probes: tuple[str, ...] = ()):
        self.spark, self.fetch, self.expand, self.limits, self.gate, self.check = spark, fetch, expand, limits, gate, check
        self.path = path or scratch(spark, "crawl")
        self.scope = json.dumps({"seeds": sorted(set(seeds)), "probes": list(probes), **asdict(limits), "max_pages": 0}, sort_keys=True)  # a later run may have a larger budget
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.waves: list[int] = []
        known = self._manifest()
        if known and not fresh:
            if known["scope"] != self.scope:
                raise ValueError("the stored crawl has other seeds or limits; start it afresh or elsewhere")
            self.waves = [] if known["complete"] else known["waves"]
        if not self.waves:
            self._fs.delete(self._at(self.path), True)
            rows = seed_rows(spark, seeds, limits)
            if probes:
                found = probe_rows(spark, rows.select(F.regexp_replace(urls.homepage(F.col("url")), "/$", "").alias("root")), probes)
                url = _form(limits)(F.col("url"))
                found = found.select(urls.url_hash(url).alias("urlhash"), "kind", url.alias("url"), "source", F.lit(0).alias("depth"), F.lit(1 << 40).alias("seq"), F.lit(0).alias("priority"), F.lit(0).alias("wave"))
                rows = R.first_per_key(rows.unionByName(found), ["urlhash"], ["seq"]).select(*COLUMNS)
            rows.write.parquet(f"{self.path}/frontier/wave=0")
            self._commit([0], False)

    def _manifest(self) -> dict | None:
        at = self._at(f"{self.path}/manifest.json")
        if not self._fs.exists(at):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest.json").collect()))

    def _commit(self, waves: list[int], complete: bool) -> None:
        """The manifest replaces the old one by a rename: a wave counts only once it is whole."""
        self.waves = waves
        draft = self._at(f"{self.path}/manifest.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"scope": self.scope, "waves": waves, "complete": complete}).encode()))
        out.close()
        final = self._at(f"{self.path}/manifest.json")
        self._fs.delete(final, False)
        self._fs.rename(draft, final)

    # --- what is stored -------------------------------------------------------------------------
    def _stored(self, what: str, schema: str | None = None, waves: list[int] | None = None) -> DataFrame | None:
        """The tables ``what`` of whole waves as one; None, or an empty table of ``schema``, where there is none."""
        paths = [p for n in (self.waves[:-1] if waves is None else waves) if self._fs.exists(self._at(p := f"{self.path}/{what}/wave={n}"))]
        if not paths:
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.parquet(*paths)

    def wave(self, n: int) -> DataFrame:
        return self.spark.read.schema(FRONTIER).parquet(f"{self.path}/frontier/wave={n}")

    def frontier(self) -> DataFrame:
        """All addresses of whole waves, each once (a wave may carry what an earlier one had no room for)."""
        rows = self._stored("frontier", FRONTIER, self.waves).select(*COLUMNS)
        homes = self._stored("homes")
        if homes is not None:
            rows = rows.unionByName(homes.select(*COLUMNS))
        return R.first_per_key(rows, ["urlhash"], ["wave", "seq"]) if self.limits.wave_size or self.limits.max_pages or homes is not None else rows

    def responses(self) -> DataFrame | None:
        return self._stored("responses")

    def checks(self) -> DataFrame | None:
        """Status of the resources and probes, with ``source`` and ``kind``."""
        return self._stored("checks")

    def held(self) -> DataFrame:
        """(url, why): pages of whole waves that were not fetched; ``robots`` or ``host_cap``."""
        return self._stored("held", "url string, why string")

    def skips(self) -> DataFrame:
        """(netloc, pattern_skipped, query_skipped): references the caps refused, a site."""
        c = self._stored("counters", COUNTERS)
        count = lambda cap: F.coalesce(F.sum(F.when(F.col("cap") == cap, F.col("skipped"))), F.lit(0))
        return c.groupBy(F.col("site").alias("netloc")).agg(count("prefix").alias("pattern_skipped"), count("query").alias("query_skipped"))

    def pending(self) -> DataFrame:
        """Addresses that wait, in their order: what a later run begins with. Resources wait only where there is a check for them."""
        done = self.held().select("url")
        for t in (self.responses(), self.checks()):
            done = done if t is None else done.unionByName(t.select("url"))
        rows = self.frontier()
        return R.unseen(rows if self.check is not None else rows.where("kind = 'page'"), done, ["url"]).orderBy(*ORDER)

    # --- one wave -------------------------------------------------------------------------------
    def _write(self, df: DataFrame, what: str, n: int) -> DataFrame:
        at = f"{self.path}/{what}/wave={n}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _homes(self, pages: DataFrame, n: int) -> DataFrame:
        """``pages`` and, for each host met for the first time, its front page, next after the first page of it."""
        host = urls.netloc(F.col("url"))
        fetched = self.responses()
        fresh = pages.withColumn("_host", host)
        if fetched is not None:
            fresh = R.unseen(fresh, fetched.select(host.alias("_host")), ["_host"])
        home = _form(self.limits)(urls.homepage(F.col("url")))
        first = R.first_per_key(fresh, ["_host"], ORDER).drop("_host")
        made = first.withColumn("source", F.col("url")).withColumn("url", home).withColumn("urlhash", urls.url_hash(F.col("url"))).where("url <> source").withColumn("wave", F.lit(n))
        done = self.held().select("url")
        if fetched is not None:
            done = done.unionByName(fetched.select("url"))
        made = self._write(R.unseen(made, done, ["url"]).select(*COLUMNS), "homes", n)
        rows = pages.withColumn("_home", F.lit(0)).unionByName(made.withColumn("_home", F.lit(1)))
        return R.first_per_key(rows, ["urlhash"], ["priority", "depth", "seq", "_home"])

    def _chosen(self, pages: DataFrame, n: int) -> DataFrame:
        """Those of a wave's pages that are fetched: allowed, within the cap of their host and the budget of pages."""
        limits, fetched = self.limits, self.responses()
        order = ORDER
        if limits.home_first:
            pages, order = self._homes(pages, n), ["priority", "depth", "seq", "_home", "urlhash"]
        if self.gate is not None:
            pages = self._write(self.gate(self, pages), "gated", n)
            held = pages.where("NOT allowed").select("url", F.lit("robots").alias("why"))
            pages = pages.where("allowed").drop("allowed")
        else:
            held = pages.limit(0).select("url", F.lit("robots").alias("why"))
        if limits.max_per_host:
            host = urls.netloc(F.col("url"))
            ranked = R.cap_per_group(pages.withColumn("_host", host), ["_host"], order, limits.max_per_host, rank="_place")
            if fetched is not None:
                used = fetched.groupBy(host.alias("_host")).agg(F.count(F.lit(1)).alias("_used"))
                ranked = ranked.join(used, "_host", "left").where(F.col("_place") + F.coalesce("_used", F.lit(0)) <= limits.max_per_host).drop("_used")
            chosen = cut(ranked.drop("_place", "_host"), "crawl-wave")
            held = held.unionByName(R.unseen(pages, chosen, ["urlhash"]).select("url", F.lit("host_cap").alias("why")))
            pages = chosen
        self._write(held, "held", n)
        if limits.max_pages:
            pages = R.global_cap(pages, order, limits.max_pages, 0 if fetched is None else fetched.count())
        return pages.select(*COLUMNS)

    def step(self) -> bool:
        """Fetch the last wave and write the next; False when there is nothing left, or no page may be fetched any more."""
        n, limits = self.waves[-1], self.limits
        wave = self.wave(n)
        if not wave.limit(1).count():
            self._commit(self.waves, True)
            return False
        if limits.max_pages and (got := self.responses()) is not None and got.count() >= limits.max_pages:
            return False  # not complete: what waits is there for a larger budget
        whole, rest = wave, None
        if limits.wave_size:  # best first: what has no room waits, and competes with what is found meanwhile
            wave = R.global_cap(whole, ORDER, limits.wave_size)
            rest = R.unseen(whole, wave, ["urlhash"])
        pages = wave.where("kind = 'page'")
        if self.gate is not None or limits.max_per_host or limits.max_pages or limits.home_first:
            pages = cut(self._chosen(pages, n), "crawl-pages")
        if limits.max_pages:  # beyond the budget: waits for the next wave of a run with a larger one
            over = R.unseen(R.unseen(wave.where("kind = 'page'"), pages, ["urlhash"]), self._stored("held", "url string, why string", [n]), ["url"])
            rest = over if rest is None else rest.unionByName(over)
        answers = self._write(self.fetch(pages), "responses", n)  # fetched once: readers of it never fetch again
        if self.check is not None:
            others = wave.where("kind <> 'page'")
            self._write(self.check(others).join(others.select("url", "source", "kind"), "url"), "checks", n)
        links = self.expand(answers, pages)
        place = pages.select(F.col("url"), "depth", F.col("seq").alias("from_seq"))
        at = F.col("ord").cast("long") if "ord" in links.columns else F.lit(0).cast("long")
        links = links.withColumn("_at", at).join(place, "url").select("url", "target", "kind", (F.col("depth") + 1).alias("depth"), F.struct("from_seq", F.col("_at").alias("place")).alias("seq"))
        scope = self.wave(0).where("kind = 'page'").select(urls.site_key(F.col("url")).alias("site"))
        known = self.frontier().select("urlhash")
        if limits.home_first:
            known = known.unionByName(self.spark.read.parquet(f"{self.path}/homes/wave={n}").select("urlhash"))
        new, counters = candidates(links, limits, scope, known, self._stored("counters"))
        if counters is not None:
            self._write(counters, "counters", n)
        if limits.max_rows:
            new = R.global_cap(new, ORDER, limits.max_rows, self.frontier().count())
        new = new.withColumn("_late", F.lit(1))
        if rest is not None:  # what waited was found before
            new = new.unionByName(rest.drop("wave").withColumn("seq", F.struct(F.col("seq").alias("from_seq"), F.lit(0).cast("long").alias("place"))).withColumn("_late", F.lit(0)))
        new = _numbered(new, ["_late", "seq", "urlhash"])
        new.withColumn("wave", F.lit(n + 1)).select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/frontier/wave={n + 1}")
        self._commit([*self.waves, n + 1], False)
        return True

    def run(self, waves: int = 0) -> Crawl:
        """Steps until nothing is left, or so many waves."""
        left = waves or -1
        while left and self.step():
            left -= 1
        return self


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``seq`` anew: ascending in ``order``, with gaps, and within 64 bits at any depth."""
    return rows.orderBy(*order).withColumn("seq", F.monotonically_increasing_id())


def traverse(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(node, depth) of the nodes of ``edges`` (src, dst) within ``most`` steps of ``start`` (node): breadth first, each node once.

    Visited nodes are in shared storage after each wave; the loop holds nothing but their paths.
    """
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)), "traverse")
    wave = seen
    for depth in range(1, most + 1):
        nxt = wave.join(edges, wave["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        wave = cut(R.unseen(nxt, seen, ["node"]).withColumn("depth", F.lit(depth)), "traverse")
        if not wave.limit(1).count():
            break
        seen = seen.unionByName(wave)
    return seen
