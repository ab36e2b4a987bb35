"""Registry of the core queries: name -> (spark, directory) -> DataFrame.

Every query reads whole tables. Where the tables have no column of the kind an operator needs
(status codes, markup), one is derived from a key by a rule that SQL states too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import reports, rules
from quarrylight.functions import html, images, responses, robots, secrets, urls
from quarrylight.functions import text as T
from quarrylight.operators import frontier, hot_keys
from quarrylight.operators import relational as R
from quarrylight.plans import pipelines
from quarrylight.storage import cut, spread, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers with an address, each delivered line once."""
    return table(spark, d, "frontier").where("url IS NOT NULL").select("offer_id", "kind", "url", "source", "depth", "state").distinct()


# --- hot keys -----------------------------------------------------------------------------------
@query
def p5_found(spark, d):
    return hot_keys.hot_pairs(table(spark, d, "findings"), table(spark, d, "site_stats"))


@query
def p5_pair_rollup(spark, d):
    return hot_keys.pair_rollup(table(spark, d, "findings"), table(spark, d, "site_stats"))


# --- addresses ----------------------------------------------------------------------------------
@query
def url_split(spark, d):
    return _offers(spark, d).select("offer_id", urls.scheme(F.col("url")).alias("scheme"), urls.netloc(F.col("url")).alias("netloc"), urls.raw_path(F.col("url")).alias("path"), urls.query(F.col("url")).alias("query"))


@query
def url_canonical(spark, d):
    c = urls.canonical(F.col("url"))
    return _offers(spark, d).select("offer_id", c.alias("canonical"), urls.url_hash(c).alias("hash"))


@query
def url_without_query(spark, d):
    return _offers(spark, d).select("offer_id", urls.without_query(F.col("url")).alias("page"))


@query
def url_roaming_form(spark, d):
    return _offers(spark, d).select("offer_id", urls.roaming_form(F.col("url")).alias("page"), urls.homepage(F.col("url")).alias("home"))


@query
def url_site_rollup(spark, d):
    return _offers(spark, d).groupBy(urls.site_key(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("kind").alias("kinds"), F.min("depth").alias("least_depth")).withColumn("stem", urls.site_file_stem(F.col("site")))


@query
def url_resolved(spark, d):
    href = F.concat(F.lit("../p"), F.col("offer_id").cast("string"), F.lit("?q=1#top"))
    return _offers(spark, d).where("kind = 'page'").select("offer_id", urls.resolve(F.concat(urls.homepage(F.col("url")), F.lit("a/b/c")), href).alias("target"))


@query
def url_seed_form(spark, d):
    return _offers(spark, d).select(urls.with_scheme(urls.site_key(F.col("url"))).alias("seed")).distinct()


@query
def tracking_params_stripped(spark, d):
    named = F.explode(F.filter(F.split(urls.query(F.col("url")), "&"), lambda kv: kv != ""))
    rows = _offers(spark, d).select(named.alias("kv")).select(F.lower(F.substring_index("kv", "=", 1)).alias("name"))
    return rows.where(F.col("name").isin(*rules.TRACKING_PARAMS)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def url_prefix_bucket(spark, d):
    return _offers(spark, d).groupBy(urls.site_key(F.col("url")).alias("site"), urls.path_prefix(F.col("url"), 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def prefix_cap(spark, d):
    rows = _offers(spark, d).select("offer_id", urls.site_key(F.col("url")).alias("site"), urls.path_prefix(F.col("url"), 1).alias("bucket")).where("bucket <> ''")
    return R.cap_per_group(rows, ["site", "bucket"], ["offer_id"], 3)


@query
def prefix_cap_skips(spark, d):
    rows = _offers(spark, d).select(urls.site_key(F.col("url")).alias("site"), urls.path_prefix(F.col("url"), 1).alias("bucket")).where("bucket <> ''")
    return R.skipped_by_cap(rows, ["site", "bucket"], 3)


@query
def query_variant_cap(spark, d):
    rows = _offers(spark, d).select("offer_id", urls.site_key(F.col("url")).alias("site"), urls.raw_path(F.col("url")).alias("path"), urls.query(F.col("url")).alias("query")).where("query <> ''")
    return R.cap_per_group(rows, ["site", "path"], ["offer_id"], 1)


@query
def link_priority_order(spark, d):
    rows = _offers(spark, d).select("offer_id", urls.link_priority(F.col("url")).alias("priority"))
    return rows.orderBy("priority", "offer_id")


@query
def sensitive_files(spark, d):
    ends = F.element_at(F.array(*map(F.lit, ("/db.sql", "/users_export.csv", "/sitemap.xml", "/data.json", "/a.PDF", "/notes.txt", ""))), (F.col("offer_id") % 7 + 1).cast("int"))
    u = F.concat(urls.without_query(F.col("url")), ends)
    return _offers(spark, d).select("offer_id", urls.sensitive_verdict(u).alias("verdict"), urls.legacy_file(u).alias("legacy"), urls.flagged_file(u).alias("flagged"))


@query
def risky_params(spark, d):
    asked = F.element_at(F.array(*map(F.lit, ("next=https://e.test/x", "f=../../etc", "p=/etc/passwd", "debug=1", "id=5", "ref=//k.test"))), (F.col("offer_id") % 6 + 1).cast("int"))
    rows = _offers(spark, d).select("offer_id", F.explode(urls.risky_params(F.concat(urls.without_query(F.col("url")), F.lit("?"), asked))).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def bot_hostile(spark, d):
    host = F.concat(F.element_at(F.array(*map(F.lit, ("www.facebook.com", "m.x.com", "netflix.com", "a.linkedin.com"))), (F.col("offer_id") % 4 + 1).cast("int")))
    rows = _offers(spark, d).select(F.when(F.col("offer_id") % 5 == 0, host).otherwise(urls.netloc(F.col("url"))).alias("host"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("hostile", urls.bot_hostile(F.col("host")))


@query
def hosts_below_domains(spark, d):
    rows = _offers(spark, d).select("offer_id", urls.netloc(F.col("url")).alias("host"))
    return R.below_domain(rows, "host", table(spark, d, "site_stats").select("netloc")).select("offer_id")


# --- the frontier -------------------------------------------------------------------------------
@query
def frontier_state_counts(spark, d):
    return R.state_counts(table(spark, d, "frontier").select("offer_id", "state").distinct())


@query
def frontier_pending(spark, d):
    return R.pending_and_active(table(spark, d, "frontier").select("offer_id", "state").distinct())


@query
def frontier_dedupe(spark, d):
    rows = table(spark, d, "frontier").select(urls.offered_key(F.col("urlhash"), F.col("url")).alias("key"), "offer_id", "kind", "depth").where("key IS NOT NULL")
    return R.first_per_key(rows, ["key"], ["offer_id"])


@query
def frontier_scope(spark, d):
    sites = table(spark, d, "findings").where("netloc IS NOT NULL").select("netloc").distinct()
    return R.in_scope(_offers(spark, d).select("offer_id", "url"), "url", sites).select("offer_id")


@query
def frontier_unseen(spark, d):
    offers = _offers(spark, d)
    done = offers.where("state = 2").select(urls.canonical(F.col("url")).alias("page"))
    return R.unseen(offers.where("state = 0").select("offer_id", urls.canonical(F.col("url")).alias("page")), done, ["page"])


@query
def frontier_page_cap(spark, d):
    rows = _offers(spark, d).where("kind = 'page'").select("offer_id", urls.netloc(F.col("url")).alias("host"))
    return R.cap_per_group(rows, ["host"], ["offer_id"], 25)


@query
def frontier_first_depth(spark, d):
    rows = _offers(spark, d).select(urls.canonical(F.col("url")).alias("page"), "offer_id", "depth", "source")
    return R.first_per_key(rows, ["page"], ["offer_id"])


@query
def frontier_bfs(spark, d):
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    pairs = cut(table(spark, d, "lineitem").select(p.alias("p"), s.alias("s")).distinct(), "bfs-edges")  # every wave reads them
    edges = pairs.select(F.col("p").alias("src"), F.col("s").alias("dst")).union(pairs.select(F.col("s").alias("src"), F.col("p").alias("dst")))
    return frontier.traverse(edges, spark.createDataFrame([("s1",)], "node string"), 3)


# --- crawls of recorded pages -------------------------------------------------------------------
def _node(asked: bool) -> tuple[Column, Column]:
    """Host and address of an offer as a page: its own host and first path segment; with ``asked`` even numbers stand in the query."""
    u, o = F.col("url"), F.col("offer_id").cast("string")
    host = F.regexp_replace(urls.site_key(u), r":\d*$", "")
    bucket = urls.path_prefix(u, 1)
    folder = F.concat(F.lit("/"), bucket)
    page = F.concat(F.when(bucket == "", F.lit("")).otherwise(folder), F.lit("/o"), o)
    if asked:
        page = F.when(F.col("offer_id") % 2 == 0, F.concat(folder, F.lit("?o="), o)).otherwise(page)
    return host, F.concat(F.lit("https://"), host, page)


def _graph(spark: SparkSession, d: str, asked: bool = False, status: bool = False) -> DataFrame:
    """All offers as recorded pages of a tree: number n is linked from n div 3, the first ones from the start page."""
    host, page = _node(asked)
    nodes = cut(_offers(spark, d).select("offer_id", host.alias("host"), page.alias("u")).distinct(), "graph")
    anchors = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offer_id", "u"))), lambda c: F.concat(F.lit('<a href="'), T.escape(c["u"]), F.lit('">n</a>'))), "")
    links = nodes.groupBy(F.floor(F.col("offer_id") / 3).alias("offer_id")).agg(anchors.alias("anchors"))  # three at most
    start = spark.createDataFrame([(0, "start.test", "https://start.test/")], "offer_id long, host string, u string")
    body = F.concat(F.lit("<html>"), F.coalesce("anchors", F.lit("")), F.lit('<img src="https://img.test/'), (F.col("offer_id") % 20).cast("string"), F.lit('.png"></html>'))
    pages = start.unionByName(nodes).join(links, "offer_id", "left").select(F.col("u").alias("url"), body.alias("body"), (F.when(F.col("offer_id") % 3 == 2, _status(F.col("offer_id"))).otherwise(200) if status else F.lit(200)).alias("status"))
    if status:  # pictures, and a robots.txt on every host
        pictures = spark.range(20).select(F.concat(F.lit("https://img.test/"), F.col("id").cast("string"), F.lit(".png")).alias("url"), F.lit("").alias("body"), _status(F.col("id")).alias("status"))
        texts = nodes.select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url")).distinct().select("url", F.lit("User-agent: *\nDisallow: /*7$").alias("body"), F.lit(200).alias("status"))
        pages = pages.unionByName(pictures).unionByName(texts).withColumn("headers", F.create_map(F.lit("Server"), F.lit("nginx/1.2")))
    return cut(pages, "graph-pages")


_DONE: dict = {}


def _once(spark: SparkSession, key: tuple, make):
    """What several queries of a session look at is crawled once; its tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _DONE:
        _DONE[key] = make()
    return _DONE[key]


def _crawl(spark: SparkSession, d: str, limits: frontier.Limits, asked: bool = False) -> frontier.Crawl:
    return _once(spark, (d, limits, asked), lambda: pipelines.crawl(spark, ["https://start.test/"], _graph(spark, d, asked), limits, roam=True))


@query
def crawl_waves(spark, d):
    c = _crawl(spark, d, frontier.Limits(allow_external=True))
    return c.frontier().where("kind = 'page'").select("url", "source", "depth", "wave")


@query
def crawl_capped(spark, d):
    c = _crawl(spark, d, frontier.Limits(allow_external=True, max_per_prefix=8, max_query_variants=3), asked=True)
    return c.frontier().where("kind = 'page'").select("url", "depth")


@query
def crawl_skips(spark, d):
    return _crawl(spark, d, frontier.Limits(allow_external=True, max_per_prefix=8, max_query_variants=3), asked=True).skips()


@query
def crawl_host_cap(spark, d):
    return _crawl(spark, d, frontier.Limits(allow_external=True, max_per_host=40)).responses().select("url")


def _audit(spark: SparkSession, d: str):
    return _once(spark, (d, "audit"), lambda: pipelines.whole_audit(spark, ["https://start.test/"], _graph(spark, d, status=True), frontier.Limits(allow_external=True), robots_txt="wildcard"))


@query
def deep_audit_findings(spark, d):
    return _audit(spark, d)[1].groupBy("netloc", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def deep_audit_stats(spark, d):
    return _audit(spark, d)[2].select("netloc", "pages_crawled", "robots_blocked")


@query
def probe_matrix(spark, d):
    roots = _offers(spark, d).select(F.concat(urls.scheme(F.col("url")), F.lit("://"), F.lower(urls.netloc(F.col("url")))).alias("root")).distinct()
    return pipelines.probe_targets(spark, roots).select("url", "source")


# --- findings -----------------------------------------------------------------------------------
@query
def finding_distinct(spark, d):
    return R.distinct_findings(table(spark, d, "findings"))


@query
def finding_counts(spark, d):
    return R.category_counts(table(spark, d, "findings"))


@query
def finding_summary(spark, d):
    names = tuple(k for k, _ in rules.FINDING_CATEGORIES)
    clean = hot_keys.clean_findings(table(spark, d, "findings")).withColumn("id", F.lit(0))
    return R.category_summary(clean, names)


@query
def finding_first_per_site(spark, d):
    rows = table(spark, d, "findings").where("netloc IS NOT NULL").select(urls.clean_host(F.col("netloc")).alias("netloc"), "category", "id", "url")
    return R.first_per_key(rows, ["netloc", "category"], ["id"])


@query
def finding_severity(spark, d):
    display = F.create_map(*(F.lit(x) for k, v in rules.FINDING_CATEGORIES for x in (k, v)))
    rows = table(spark, d, "findings").select(F.coalesce(display[F.lower(F.trim("category"))], "category").alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("severity", T.severity(F.col("category")))


@query
def report_rows(spark, d):
    return reports.report_rows(hot_keys.clean_findings(table(spark, d, "findings")), table(spark, d, "site_stats")).drop("position")


@query
def report_search(spark, d):
    rows = table(spark, d, "findings").select("id", "category", "detail", "url", "found_on")
    return R.search_rows(rows, "Header", ("broken", "broken_resource", "secret")).select("id")


@query
def report_mixed_sort(spark, d):
    rows = table(spark, d, "findings").select(F.coalesce("detail", F.lit("")).alias("detail")).distinct()
    return R.sorted_rows(rows, "detail")


@query
def missing_headers(spark, d):
    return reports.missing_headers(table(spark, d, "site_stats")).select("netloc", "header")


@query
def stats_full_outer(spark, d):
    return R.stats_and_findings(table(spark, d, "site_stats"), table(spark, d, "findings"))


@query
def sites_with_data(spark, d):
    found = table(spark, d, "findings").where("netloc IS NOT NULL").select(urls.clean_host(F.col("netloc")).alias("netloc"))
    return R.sites_with_data(table(spark, d, "site_stats"), found)


@query
def site_counters(spark, d):
    event = F.element_at(F.array(*map(F.lit, ("pages_crawled", "robots_blocked", "pattern_skipped", "query_skipped"))), (F.col("offer_id") % 4 + 1).cast("int"))
    return R.site_counters(_offers(spark, d).select(urls.site_key(F.col("url")).alias("netloc"), event.alias("event")))


# --- finds --------------------------------------------------------------------------------------
@query
def finds_hall_of_fame(spark, d):
    return R.hall_of_fame(table(spark, d, "finds").select("find_id", "kind", "score", "ts"))


@query
def finds_recent(spark, d):
    return R.most_recent(table(spark, d, "finds").select("find_id", "kind"))


@query
def finds_per_kind(spark, d):
    return R.last_per_kind(table(spark, d, "finds").select("find_id", "kind"))


@query
def finds_cap_per_domain(spark, d):
    rows = table(spark, d, "finds").where("domain IS NOT NULL").select("find_id", urls.clean_host(F.col("domain")).alias("domain"))
    return R.cap_per_group(rows, ["domain"], ["find_id"], 25)


@query
def finds_counts(spark, d):
    rows = table(spark, d, "finds").select(urls.clean_host(F.col("domain")).alias("domain"), "kind", "score")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"), F.max("score").alias("best"))


@query
def find_dedupe_key(spark, d):
    rows = table(spark, d, "finds").where("text IS NOT NULL AND kind IS NOT NULL").select("find_id", T.find_key(F.col("kind"), F.col("text"), F.lower(F.col("domain"))).alias("key"))
    return R.first_per_key(rows, ["key"], ["find_id"]).select("find_id", F.sha1("key").alias("key"))


@query
def find_tags(spark, d):
    return table(spark, d, "finds").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def comment_score(spark, d):
    rows = spread(table(spark, d, "finds").where("kind = 'html_comment' AND text IS NOT NULL").select("find_id", "text")).select("find_id", T.kept_comment(F.col("text")))
    return rows.select("find_id", "kind", "score", "tags")


@query
def ascii_art(spark, d):
    return table(spark, d, "finds").where("text IS NOT NULL").select("find_id", T.ascii_art(F.col("text")).alias("art")).where("art").select("find_id")


@query
def keyword_signals(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    from quarrylight.functions.match import keywords

    return table(spark, d, "finds").select("find_id", *(low.rlike(keywords(rules.STRONG_SIGNALS[t])).alias(t.replace("-", "_")) for t in ("hiring", "greeting", "easter-egg", "confession")))


@query
def console_messages(spark, d):
    """Messages as they would stand in a script: quoted, with the odd format mark."""
    rows = table(spark, d, "finds").where("kind = 'console' AND text IS NOT NULL").select("find_id", F.concat(F.lit("%c"), "text").alias("m"))
    return rows.select("find_id", T.console_message(F.col("m")).alias("message")).where("message IS NOT NULL")


# --- documents ----------------------------------------------------------------------------------
@query
def emails_found(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@query
def emails_first_seen(spark, d):
    rows = table(spark, d, "documents").select("doc_id", urls.clean_host(F.col("domain")).alias("site"), F.explode(T.emails(F.col("text"))).alias("email"))
    return rows.groupBy("site", "email").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"))


@query
def shannon_entropy(spark, d):
    return table(spark, d, "frontier").where("urlhash IS NOT NULL").select("offer_id", "urlhash").distinct().select("offer_id", F.round(secrets.shannon_entropy(F.col("urlhash")), 6).alias("entropy"))


@query
def secret_mask(spark, d):
    return table(spark, d, "frontier").where("urlhash IS NOT NULL").select("offer_id", "urlhash").distinct().select("offer_id", secrets.mask(F.col("urlhash")).alias("masked"))


@query
def secret_scan(spark, d):
    """Keys written into documents: one of a random look and one placeholder in every fifth text."""
    key = F.concat(F.lit(' api_key = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('" password: "password" '))
    pages = table(spark, d, "documents").select(urls.clean_host(F.col("domain")).alias("netloc"), F.coalesce("url", F.lit("")).alias("url"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, key).otherwise(F.lit(""))).alias("body"))
    return secrets.scan(pages).groupBy("netloc", "category", "kind").agg(F.count_distinct("detail").alias("keys"))


@query
def corpus_dedupe(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.collapse(F.col("line")).alias("paragraph"))
    kept = lines.where(F.size(F.split("paragraph", " ")) >= 5)
    return kept.groupBy("paragraph").agg(F.min("doc_id").alias("doc_id")).select(F.sha1("paragraph").alias("paragraph"), "doc_id")


@query
def escaped_text(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha1(T.escape(F.col("text"), quotes=False)).alias("hash"))


@query
def body_signatures(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL AND url IS NOT NULL")
    return rows.groupBy(T.body_signature(F.col("text"), F.col("url")).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


# --- responses, derived from keys ---------------------------------------------------------------
def _status(key: Column) -> Column:
    r = key % 10
    return F.when(r == 0, 404).when(r == 1, 503).when(r == 2, 403).when(r == 3, 500).when(r == 4, 418).otherwise(200)


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Offers as answered requests: status and redirects by their number, markup of their own words."""
    o = F.col("offer_id")
    page = F.concat(F.lit('<html><head><link rel="stylesheet" href="/s.css"></head><body><p>page number '), o.cast("string"), F.lit(' of the site</p><a href="/n/'), (o % 50).cast("string"),
                    F.lit('#x">next</a><a href="https://k.test/" target="_blank">k</a><img src="http://i.test/'), (o % 20).cast("string"), F.lit('.png"><!-- sorry, this is a hack --></body></html>'))
    return _offers(spark, d).select("offer_id", "kind", F.col("url"), F.coalesce("source", "url").alias("source"), "depth", _status(o).alias("status"), F.when(o % 31 == 0, F.lit("timed out")).alias("error"), (o % 7 == 0).alias("redirected"),
                                    F.concat(F.col("url"), F.lit("?r")).alias("final_url"), F.lit("text/html").alias("content_type"), F.create_map(F.lit("Server"), F.lit("nginx/1.2"), F.lit("X-Frame-Options"), F.lit("DENY")).alias("headers"),
                                    F.array(F.struct(F.lit("sid").alias("name"), (o % 2 == 0).alias("secure"), F.lit(True).alias("httponly"), F.lit(False).alias("samesite"))).alias("cookies"), page.alias("body"), F.lit(3).alias("attempts"))


@query
def page_status_class(spark, d):
    rows = _responses(spark, d).where("kind = 'page'")
    c = responses.page_class(F.col("status"), F.col("error"))
    return rows.groupBy(c.alias("category"), urls.site_key(F.col("url")).alias("netloc")).agg(F.count(F.lit(1)).alias("n")).where("category IS NOT NULL")


@query
def resource_status_class(spark, d):
    rows = _responses(spark, d).where("kind <> 'page'")
    c = responses.resource_class(F.col("status"), F.col("error"), F.col("url"), F.col("source"))
    return rows.groupBy(c.alias("category"), "kind").agg(F.count(F.lit(1)).alias("n")).where("category IS NOT NULL")


@query
def head_confirmed(spark, d):
    o = F.col("offer_id")
    return _offers(spark, d).select("offer_id", responses.confirmed_status(_status(o), _status(o + 3)).alias("status"))


@query
def retry_backoff(spark, d):
    n = (F.col("offer_id") % 12).cast("int")
    rows = _offers(spark, d).select(n.alias("n")).distinct()
    return rows.select("n", responses.transient_backoff(F.col("n")).alias("transient"), responses.cooldown(F.col("n") + 1, responses.retry_after(F.when(F.col("n") % 3 == 0, F.lit(" 30 ")).when(F.col("n") % 3 == 1, F.lit("soon")))).alias("cooldown"))


@query
def response_findings(spark, d):
    rows = pipelines.page_findings(_responses(spark, d).where("kind = 'page'").drop("offer_id", "kind"))
    return rows.groupBy("netloc", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def resource_check_findings(spark, d):
    rows = pipelines.resource_findings(_responses(spark, d).where("kind <> 'page'"))
    return rows.groupBy("netloc", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def security_header_stats(spark, d):
    return pipelines.header_stats(_responses(spark, d).where("kind = 'page'"))


@query
def page_links(spark, d):
    pages = _responses(spark, d).where("kind = 'page' AND error IS NULL AND status < 400").select("url", "body").distinct()
    return html.links(html.elements(pages, "url", "body")).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def page_paragraphs(spark, d):
    pages = _responses(spark, d).where("kind = 'page'").select("url", "body").distinct()
    return html.paragraphs(html.elements(pages, "url", "body"), 5).select("paragraph").distinct()


@query
def robots_longest_match(spark, d):
    body = "User-agent: *\nDisallow: /*a\nAllow: /*-a\nDisallow: /*.php$\nUser-agent: other\nDisallow: /"
    pages = _offers(spark, d).select("offer_id", "url")
    roots = pages.select(F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url"))).alias("root")).distinct()
    rows = robots.parse(roots.withColumn("body", F.lit(body)))
    return robots.allowed(pages, rows).select("offer_id", "allowed")


@query
def image_names(spark, d):
    mime = F.element_at(F.array(*map(F.lit, ("image/webp", "image/png", "image/jpeg", "text/plain"))), (F.col("offer_id") % 4 + 1).cast("int"))
    rows = _offers(spark, d).where("kind = 'image'").select("offer_id", urls.site_key(F.col("url")).alias("site"), images.file_name(F.col("url"), mime).alias("name"))
    return R.numbered_names(rows, "site", "name", ["offer_id"])


@query
def run_totals(spark, d):
    return pipelines.totals(table(spark, d, "findings"), table(spark, d, "site_stats"))
