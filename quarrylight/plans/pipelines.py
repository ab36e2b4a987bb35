"""The tools as compositions: each takes tables of responses (recorded or fetched) and gives tables.

A crawl (``operators.frontier.Crawl``) makes the responses; what follows it is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import html, images, responses, robots, secrets, urls
from quarrylight.functions import text as T
from quarrylight.operators import relational as R
from quarrylight.operators.frontier import Crawl, Limits
from quarrylight.sources import http
from quarrylight.storage import cut

FINDING = ["netloc", "category", "url", "detail", "found_on", "kind"]


def _finding(df: DataFrame, category, url, detail, found_on, kind=None, netloc=None) -> DataFrame:
    c = F.lit(category) if isinstance(category, str) else category
    return df.select((netloc if netloc is not None else urls.site_key(F.col("url"))).alias("netloc"), c.alias("category"), url.alias("url"), detail.cast("string").alias("detail"),
                     found_on.alias("found_on"), (kind if kind is not None else F.lit(None)).cast("string").alias("kind")).where("category IS NOT NULL AND detail IS NOT NULL")


def page_findings(pages: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """All findings of crawled pages (a response with ``source`` and ``depth``), those of the markup included.

    Files and parameters are noted for reachable pages only; a page that is a not-found page in
    disguise has that finding and no others of its content.
    """
    p = pages.withColumn("netloc", urls.site_key(F.col("url")))
    url, source, status = F.col("url"), F.col("source"), F.col("status")
    fine = F.col("error").isNull() & (status < 400)
    if profiles is not None:
        p = p.join(profiles.select(urls.site_form(F.col("host")).alias("_host"), F.struct("mode", "landing", "sig").alias("_profile")), p["netloc"] == F.col("_host"), "left").drop("_host")
        p = p.withColumn("soft", responses.soft404_reason(F.col("_profile"), url, F.col("final_url"), F.col("redirected"), F.when(responses.is_html(F.col("content_type")) | responses.is_script(F.col("content_type"), url), F.col("body"))))
    else:
        p = p.withColumn("_profile", F.lit(None).cast("struct<mode:string,landing:string,sig:string>")).withColumn("soft", F.lit(None).cast("string"))
    ok = p.where(fine)
    real = ok.where("soft IS NULL")
    content = real.where(responses.is_html(F.col("content_type")) | responses.is_script(F.col("content_type"), url))
    markup = real.where(responses.is_html(F.col("content_type")))
    parsed = cut(html.elements(markup, "url", "body").where("tag <> 'p'"), "elements")  # parsed once for three detectors; no paragraph, no body
    cookies = real.select("netloc", "url", F.explode("cookies").alias("c"))
    cookies = _finding(cookies, "cookie_flag", F.col("url"), responses.cookie_flags(F.col("c.name"), F.col("c.secure"), F.col("c.httponly"), F.col("c.samesite")), F.col("url"), F.col("c.name"), F.col("netloc"))
    home = real.where("depth = 0")
    parts = [
        _finding(p, responses.page_class(status, F.col("error")), url, responses.page_detail(status, F.col("error"), F.col("redirected"), F.col("final_url"), F.col("attempts")), source),
        _finding(ok.where(urls.legacy_file(url)), "legacy_file", url, status, source),
        _finding(ok, "sensitive_file", url, F.when(urls.sensitive_verdict(url) == "high", status.cast("string")).when(urls.sensitive_verdict(url) == "context", F.concat(status.cast("string"), F.lit(" (dump-like filename)"))), source),
        _finding(ok.select("url", "source", F.explode(urls.risky_params(url)).alias("reason")), "risky_param", url, F.col("reason"), source),
        _finding(ok, "broken", url, F.concat(F.lit("soft 404 - "), "soft"), source),
        _finding(markup.where(responses.directory_listing(F.col("body"))), "directory_listing", url, status, source),
        R.first_per_key(cookies, ["netloc", "kind"], ["url"]).withColumn("kind", F.lit(None).cast("string")),
        R.first_per_key(_finding(home, "version_disclosure", url, responses.version_disclosure(F.col("headers")), url), ["netloc"], ["url"]),
        R.first_per_key(_finding(ok, "scan_caveat", urls.homepage(url), responses.soft404_caveat(F.col("_profile.mode")), F.lit(None).cast("string")), ["netloc", "url"], ["detail"]),
        secrets.scan(content).withColumn("found_on", F.lit(None).cast("string")),
        *(f(parsed).withColumn("kind", F.lit(None).cast("string")) for f in (html.mixed_content, html.third_party_scripts, html.tabnabbing)),
    ]
    return R.union_all([x.select(*FINDING) for x in parts])


def resource_findings(checks: DataFrame) -> DataFrame:
    """Findings of status checks (url, source, kind, status, error, redirected, final_url), laid to the referring site."""
    url, source, status, error = (F.col(c) for c in ("url", "source", "status", "error"))
    site = urls.site_key(source)
    main = _finding(checks, responses.resource_class(status, error, url, source), url, responses.resource_detail(status, error, url, source, F.col("redirected"), F.col("final_url")), source, F.col("kind"), site)
    hostile = urls.bot_hostile(urls.site_key(F.col("url")))
    noted = R.first_per_key(main.where(hostile).withColumn("_host", urls.site_key(F.col("url"))), ["netloc", "_host"], ["url", "found_on"]).drop("_host")
    reached = checks.where(error.isNull() & (status < 400) & ~urls.bot_hostile(urls.site_key(url)))
    return R.union_all([x.select(*FINDING) for x in (
        main.where(~hostile), noted, _finding(reached.where(urls.legacy_file(url)), "legacy_file", url, status, source, netloc=site),
        _finding(reached, "sensitive_file", url, F.when(urls.sensitive_verdict(url) == "high", status.cast("string")).when(urls.sensitive_verdict(url) == "context", F.concat(status.cast("string"), F.lit(" (dump-like filename)"))), source, netloc=site))])


def probe_findings(checks: DataFrame) -> DataFrame:
    """Findings of probed paths."""
    return _finding(checks.where("error IS NULL"), "exposed_path", F.col("url"), responses.probe_detail(F.col("status")), F.col("source"))


def header_stats(pages: DataFrame) -> DataFrame:
    """(netloc, header_checked_url, missing_headers): the first reachable front page of each site decides."""
    home = pages.where("error IS NULL AND status < 400 AND depth = 0").select(urls.site_key(F.col("url")).alias("netloc"), F.col("url").alias("header_checked_url"), F.to_json(responses.missing_security_headers(F.col("headers"))).alias("missing_headers"))
    return R.first_per_key(home, ["netloc"], ["header_checked_url"])


def site_stats(pages: DataFrame, blocked: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """Counters of a crawl: answered pages, pages robots kept out, and what the caps refused (``Crawl.skips``)."""
    events = pages.where("error IS NULL").select(urls.site_key(F.col("url")).alias("netloc"), F.lit("pages_crawled").alias("event"))
    counts = R.site_counters(events.unionByName(blocked.select(urls.site_key(F.col("url")).alias("netloc"), F.lit("robots_blocked").alias("event"))))
    if skips is not None:
        counts = counts.drop("pattern_skipped", "query_skipped").join(skips, "netloc", "full_outer")
        counts = counts.select("netloc", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages_crawled", "robots_blocked", "pattern_skipped", "query_skipped")))
    return counts.join(header_stats(pages), "netloc", "left")


def expand_links(scope: DataFrame | None = None, allow_external: bool = False):
    """A crawl's ``expand``: the references of reachable HTML pages."""

    def expand(answers: DataFrame, wave: DataFrame) -> DataFrame:
        pages = answers.where("error IS NULL AND status < 400").where(responses.is_html(F.col("content_type")))
        return html.links(html.elements(pages, "url", "body"), scope, allow_external)

    return expand


# --- robots as gates of a crawl -----------------------------------------------------------------
def root_of(url) -> Column:
    """Scheme and host of an address: whose robots.txt holds for it."""
    return F.concat(urls.scheme(url), F.lit("://"), urls.netloc(url))


def known_rules(rules_table: DataFrame):
    """A gate by rules that are there already."""
    return lambda c, pages: robots.allowed(pages, rules_table)


def fetched_rules(fetch, style: str = "wildcard"):
    """A gate that fetches the robots.txt of each root the first time a wave has it, and keeps it with the wave.

    ``wildcard`` takes patterns and the longest match, ``standard`` the standard parser's verdict.
    A file that can't be had allows everything.
    """

    def gate(c: Crawl, pages: DataFrame) -> DataFrame:
        roots = pages.select(root_of(F.col("url")).alias("root")).distinct()
        known = c._stored("robots")
        if known is not None:
            roots = R.unseen(roots, known, ["root"])
        asked = roots.withColumn("url", F.concat("root", F.lit("/robots.txt")))
        got = fetch(asked.select("url")).where("error IS NULL AND status < 400").select("url", "body")
        files = c._write(asked.join(got, "url", "left").select("root", "body"), "robots", c.waves[-1])
        files = files if known is None else files.unionByName(known)
        if style == "wildcard":
            return robots.allowed(pages, robots.parse(files))
        joined = pages.withColumn("_root", root_of(F.col("url"))).join(files.withColumnsRenamed({"root": "_root", "body": "_body"}), "_root", "left")
        return joined.withColumn("allowed", robots.standard_allowed(F.col("_body"), F.col("url"))).drop("_root", "_body")

    return gate


def crawl(spark: SparkSession, seeds: list[str], pages: DataFrame | None = None, limits: Limits = Limits(), path: str | None = None, rules_table: DataFrame | None = None, options: dict | None = None, fresh: bool = False,
          robots_txt: str | None = None, check: bool = False, probes: tuple[str, ...] = (), roam: bool = False, begin_only: bool = False) -> Crawl:
    """A crawl of recorded pages, or of the network where none are given.

    Pages are held back by ``rules_table``, or by the robots.txt of their root where ``robots_txt``
    names a style. ``check`` asks for the status of resources and of ``probes``. ``roam`` follows
    every anchor, whatever its site. ``begin_only`` leaves the waves to the caller.
    """
    fetch = http.recorded(pages) if pages is not None else http.fetch_wave(options)
    status = http.recorded(pages, http.STATUS) if pages is not None else http.check_wave(options)
    gate = known_rules(rules_table) if rules_table is not None else fetched_rules(fetch, robots_txt) if robots_txt else None
    scope = spark.createDataFrame([(s,) for s in seeds], "s string").select(urls.site_key(urls.with_scheme(F.col("s"))).alias("site"))
    expand = expand_links() if roam else expand_links(scope, limits.allow_external)
    c = Crawl(spark, seeds, fetch, expand, limits, path, fresh, gate, status if check else None, probes)
    return c if begin_only else c.run()


def roaming(max_pages: int = 500, max_per_host: int = 25, home_first: bool = False) -> Limits:
    """Limits of a crawl without borders: a budget of pages, a cap a host, addresses told apart by their query."""
    return Limits(max_pages=max_pages, max_per_host=max_per_host, allow_external=True, form="roaming", home_first=home_first)


def deep_audit(c: Crawl, profiles: DataFrame | None = None) -> DataFrame:
    """Findings of a crawl: its pages, the resources they refer to, and probed paths; repeats across resumed runs removed."""
    rows = c.frontier().select("url", "source", "depth")
    parts = [] if (answers := c.responses()) is None else [page_findings(answers.join(rows, "url"), profiles)]
    if (checks := c.checks()) is not None:
        parts += [resource_findings(checks.where("kind <> 'probe'")), probe_findings(checks.where("kind = 'probe'"))]
    return R.distinct_findings(R.union_all([p.select(*FINDING) for p in parts]))


def audit_stats(c: Crawl) -> DataFrame:
    """Statistics a site of a crawl: pages, robots, caps, and the headers of the front page."""
    answers = c.responses().join(c.frontier().select("url", "depth"), "url")
    return site_stats(answers, c.held().where("why = 'robots'"), c.skips())


def audit_crawl(spark: SparkSession, seeds: list[str], pages: DataFrame | None = None, limits: Limits = Limits(max_rows=5000), path: str | None = None, options: dict | None = None, fresh: bool = False,
                robots_txt: str | None = "standard", probe: bool = False) -> Crawl:
    """The crawl of an audit before its first wave: robots, checks of resources, and probes if wanted."""
    return crawl(spark, seeds, pages, limits, path, None, options, fresh, robots_txt, True, rules.COMMON_PROBE_PATHS if probe else (), begin_only=True)


def audit_tables(c: Crawl, fetch, soft404: bool = True, token: str = "quarrylight") -> tuple[DataFrame, DataFrame]:
    """(findings, statistics) of a crawl as far as it has come."""
    profiles = None
    if soft404 and c.responses() is not None:
        roots = c.responses().select(F.concat(urls.scheme(F.col("url")), F.lit("://"), F.lower(urls.netloc(F.col("url")))).alias("root")).distinct()
        profiles = cut(soft404_profiles(roots, fetch, token), "profiles")  # fetched once
    return deep_audit(c, profiles), audit_stats(c)


def whole_audit(spark: SparkSession, seeds: list[str], pages: DataFrame | None = None, limits: Limits = Limits(max_rows=5000), path: str | None = None, options: dict | None = None, fresh: bool = False,
                robots_txt: str | None = "standard", soft404: bool = True, probe: bool = False, token: str = "quarrylight") -> tuple[Crawl, DataFrame, DataFrame]:
    """(crawl, findings, statistics): pages, resources, probes, not-found pages in disguise, headers and robots in one go."""
    fetch = http.recorded(pages) if pages is not None else http.fetch_wave(options)
    c = audit_crawl(spark, seeds, pages, limits, path, options, fresh, robots_txt, probe).run()
    return c, *audit_tables(c, fetch, soft404, token)


def quick_scan(answers: DataFrame, links: DataFrame) -> DataFrame:
    """(url, kind, found_on, status_text, broken, flagged, hostile, host): every reference of a site with its status; flagged files whatever their status."""
    refs = links.select(F.col("target").alias("url"), "kind", F.col("url").alias("found_on"))
    refs = R.first_per_key(refs, ["url"], ["found_on", "kind"])
    joined = refs.join(answers.select("url", "status", "error"), "url", "left")
    host = urls.site_key(F.col("url"))
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), "error")).otherwise(F.col("status").cast("string"))
    hostile = urls.bot_hostile(host) & (F.col("kind") != "page")
    return joined.select("url", "kind", "found_on", text.alias("status_text"), (~hostile & (F.col("error").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(False)))).alias("broken"), urls.flagged_file(F.col("url")).alias("flagged"), hostile.alias("hostile"), host.alias("host"))


def email_audit(answers: DataFrame, seq: str = "seq", body: str = "body") -> DataFrame:
    """(site, email, first_page): each address of a site with the first page it stands on."""
    pages = answers.where("error IS NULL AND status < 400").where(responses.is_html(F.col("content_type")))
    found = pages.select(urls.site_key(F.col("url")).alias("site"), F.col("url"), F.col(seq).alias("_seq"), F.explode(T.emails(F.col(body))).alias("email"))
    return found.groupBy("site", "email").agg(F.min_by("url", F.struct("_seq", "url")).alias("first_page"))


def image_scrape(answers: DataFrame, min_width: int = 100, min_height: int = 100, seen: DataFrame | None = None, most: int = 0) -> DataFrame:
    """(image_url, found_on, site, sha256, width, height, duplicate, file_name, body) of image answers large enough; the first of equal bytes is the original."""
    kept = answers.where(images.is_image(F.col("status"), F.col("content_type")) & F.col("body").isNotNull()).withColumn("_size", images.dimensions(F.col("body")))
    kept = kept.where(images.large_enough(F.col("_size"), min_width, min_height)).select(
        F.col("url").alias("image_url"), "found_on", urls.site_key(F.col("found_on")).alias("site"), images.content_hash(F.col("body")).alias("sha256"), F.col("_size.width").alias("width"), F.col("_size.height").alias("height"),
        images.file_name(F.col("url"), F.col("content_type")).alias("name"), "body")
    marked = R.mark_duplicates(kept, "sha256", ["image_url", "found_on"], seen)
    first = R.cap_per_group(marked.where("NOT duplicate"), ["site"], ["image_url", "found_on"], most)
    named = R.numbered_names(first, "site", "name", ["image_url"])
    return named.unionByName(marked.where("duplicate").withColumn("file_name", F.lit(None).cast("string"))).drop("name")


def corpus(answers: DataFrame, min_words: int = 5, body: str = "body", implied: bool = False) -> DataFrame:
    """(paragraph, url): each different content paragraph with the first page that has it."""
    pages = answers.where("error IS NULL AND status < 400").where(responses.is_html(F.col("content_type")))
    rows = html.paragraphs(html.elements(pages, "url", body, implied), min_words)
    return rows.groupBy("paragraph").agg(F.min_by("url", F.struct("url", "ord")).alias("url"))


def humans_files(pages: DataFrame, fetch) -> DataFrame:
    """Responses for the humans.txt of each host of ``pages`` (final_url), asked once a host."""
    root = F.concat(urls.scheme(F.col("final_url")), F.lit("://"), urls.netloc(F.col("final_url")))
    asked = pages.select(F.concat(root, F.lit("/humans.txt")).alias("url")).distinct()
    return fetch(asked)


def hunt(answers: DataFrame, ts: str, max_per_domain: int = 25, fetch=None) -> DataFrame:
    """Finds of pages: comments by score, console messages (5), headers (5) and humans.txt files (4), each once, capped a domain.

    With ``fetch`` the humans.txt of every host is asked for, once; without it those among the
    answers are taken.
    """
    pages = answers.where("error IS NULL AND status < 400")
    markup = pages.where(responses.is_html(F.col("content_type")))
    comment = markup.select("url", F.explode(T.html_comments(F.col("body"))).alias("raw")).select("url", "raw", T.kept_comment(F.col("raw")))
    make = lambda df, kind, text, score, tags: df.select(kind.alias("kind"), text.alias("text"), "url", urls.site_key(F.col("url")).alias("domain"), score.cast("int").alias("score"), tags.alias("tags"), F.lit(ts).alias("ts"))
    fixed = lambda x: F.array(F.lit(x))
    eggs = html.console_eggs(html.elements(markup, "url", "body"))
    headers = pages.select("url", F.explode(responses.header_eggs(F.col("headers"))).alias("egg"))
    files = humans_files(markup, fetch).where("error IS NULL") if fetch is not None else pages
    humans = files.where(urls.path(F.col("url")) == "/humans.txt").select("url", responses.humans_txt(F.col("status"), F.col("content_type"), F.col("body")).alias("t")).where("t IS NOT NULL")
    rows = R.union_all([make(comment, F.col("kind"), F.when(F.col("kind") == "ascii_art", F.regexp_replace("raw", r"^\n+|\n+$", "")).otherwise(T.collapse(F.col("raw"))), F.col("score"), F.col("tags")),
                        make(eggs, F.lit("console"), F.col("message"), F.lit(5), fixed("console")), make(headers, F.lit("header"), F.col("egg"), F.lit(5), fixed("header")),
                        make(humans, F.lit("humans_txt"), F.col("t"), F.lit(4), fixed("credits"))])
    rows = R.first_per_key(rows.withColumn("_key", T.find_key(F.col("kind"), F.col("text"), F.col("domain"))), ["_key"], ["url"])
    return R.cap_per_group(rows, ["domain"], ["url", "_key"], max_per_domain).drop("_key")


def image_links(answers: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(image_url, found_on): images of reachable pages, their srcset variants included, each once with the first page and place that has it."""
    pages = answers.where("error IS NULL AND status < 400").where(responses.is_html(F.col("content_type")))
    parsed = html.elements(pages, "url", "body")
    own = html.links(parsed, scope).where("kind = 'image'").select("url", "target")
    return own.unionByName(html.srcset_urls(parsed)).groupBy(F.col("target").alias("image_url")).agg(F.min("url").alias("found_on"))


def image_totals(images: DataFrame) -> DataFrame:
    """(site, saved, duplicates) of an ``image_scrape``."""
    return images.groupBy("site").agg(F.count_if(~F.col("duplicate")).alias("saved"), F.count_if("duplicate").alias("duplicates"))


def corpus_totals(paragraphs: DataFrame, new: DataFrame) -> DataFrame:
    """One row (paragraphs, added, duplicates): of the paragraphs of a run (paragraph), those a corpus got (``new``)."""
    return paragraphs.agg(F.count(F.lit(1)).alias("paragraphs")).crossJoin(F.broadcast(new.agg(F.count(F.lit(1)).alias("added")))).withColumn("duplicates", F.col("paragraphs") - F.col("added"))


def probe_targets(spark: SparkSession, roots: DataFrame) -> DataFrame:
    from quarrylight.operators.frontier import probe_rows

    return probe_rows(spark, roots, rules.COMMON_PROBE_PATHS)


def robots_rules(roots: DataFrame, fetch) -> DataFrame:
    """Rules of the robots.txt of each root (scheme and host), fetched once a root; failures and errors allow everything."""
    asked = roots.select(F.col(roots.columns[0]).alias("root")).where("root IS NOT NULL").distinct().withColumn("url", F.concat("root", F.lit("/robots.txt")))
    answers = fetch(asked.select("url")).where("error IS NULL AND status < 400").select("url", "body")
    return robots.parse(asked.join(answers, "url").select("root", "body"))


def soft404_profiles(roots: DataFrame, fetch, token: str) -> DataFrame:
    """(host, mode, landing, sig) of each root, from its answers for a page named by ``token``, which can't exist, and its front page."""
    base = roots.select(F.col(roots.columns[0]).alias("root")).where("root IS NOT NULL").distinct()
    base = base.withColumn("gone", F.concat("root", F.lit(f"/nf-{token}"))).withColumn("home", F.concat("root", F.lit("/")))
    answers = fetch(base.select(F.explode(F.array("gone", "home")).alias("url")))
    g = answers.select(F.col("url").alias("gone"), "status", "error", "redirected", "final_url", "body")
    h = answers.select(F.col("url").alias("home"), F.col("status").alias("home_status"), F.col("body").alias("home_body"))
    rows = base.join(g, "gone", "left").join(h, "home", "left")
    profile = responses.soft404_profile(*(F.col(c) for c in ("status", "error", "redirected", "final_url", "body", "home_status", "home_body", "root")))
    return rows.select(urls.site_key(F.col("home")).alias("host"), profile.alias("p")).select("host", "p.*")


def totals(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: sites, pages and findings of all of a run."""
    whole = R.stats_and_findings(stats, findings)
    return whole.agg(F.count(F.lit(1)).alias("sites"), F.sum("pages_crawled").alias("pages"), F.sum("robots_blocked").alias("blocked"), F.sum("findings").alias("findings"))


def with_progress(answers: DataFrame, name: str = "progress") -> DataFrame:
    """``answers`` whose counts a listener can watch while they are made."""
    return answers.observe(name, F.count(F.lit(1)).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def email_report(found: DataFrame) -> DataFrame:
    """Lines of the report of addresses, a block a site in order; a table, so that its size is nobody's concern."""
    per = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("email", "first_page"))), lambda e: F.concat(F.lit("    "), e["email"], F.lit("\n        found on: "), e["first_page"])), "\n")
    return found.groupBy("site").agg(per.alias("block"), F.count(F.lit(1)).alias("n")).select("site", F.concat("site", F.lit("\n"), "block", F.lit("\n  ("), F.col("n").cast("string"), F.lit(" email(s) found)")).alias("block")).orderBy("site")
