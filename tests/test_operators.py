"""Relational operators, hot keys, the frontier, files, reports and pipelines on small dirty tables."""

import json
import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from quarrylight import reports, rules
from quarrylight.operators import frontier, hot_keys
from quarrylight.operators import relational as R
from quarrylight.plans import pipelines, queries
from quarrylight.sources import files, http
from quarrylight.streaming import jobs


def findings_table(spark, seed=1, n=3000):
    rng, rows = random.Random(seed), []
    for i in range(n):
        host = "hot.test" if i % 3 == 0 else f"s{rng.randrange(40)}.test"
        host = rng.choice([host, host.upper(), f" www.{host} "])
        rows.append((i, None if i % 50 == 0 else host, rng.choice(["broken", " Broken", "SECRET"]), rng.choice([None, f"https://x/{rng.randrange(300)}"]), rng.choice([None, "", "404"]), rng.choice([None, "p"]), None))
    return rows, spark.createDataFrame(rows, "id long, netloc string, category string, url string, detail string, found_on string, kind string").repartition(5)


def cleaned(rows):
    out = set()
    for _, n, c, u, d, f, k in rows:
        if n is not None:
            n = n.strip().lower()
            out.add((n.removeprefix("www."), c.strip().lower(), u, d, f, k))
    return out


def test_hot_pairs_equal_brute_force(spark):
    rows, df = findings_table(spark)
    sites = spark.createDataFrame([("hot.test", 7), ("s1.test", 3), ("s1.test", 4), ("unknown.test", 1), (None, 2)], "netloc string, pages_crawled int")
    want = Counter(r[:2] for r in cleaned(rows))
    got = {(r.netloc, r.category): r for r in hot_keys.pair_rollup(df, sites).collect()}
    assert {k: r.findings for k, r in got.items()} == dict(want) and {r.all_findings for r in got.values()} == {sum(want.values())}
    assert {r.pages for (n, _), r in got.items() if n == "s1.test"} == {7} and {r.pages for (n, _), r in got.items() if n == "hot.test"} == {7} and {r.pages for (n, _), r in got.items() if n == "s2.test"} == {None}
    hot = {tuple(r) for r in hot_keys.hot_pairs(df, sites).collect()}
    assert hot == {k for k, n in want.items() if n * 100 >= sum(want.values())} and hot
    assert hot_keys.hot_pairs(df.limit(0), sites).count() == 0


def test_eager_aggregation_equals_the_join(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice(["a", "a", "b", "c", None]), rng.randrange(3), rng.choice([None, 1.5, 2.0])) for _ in range(200)], "k string, g int, v double")
    right = spark.createDataFrame([(rng.choice(["a", "b", "d", None]), rng.choice([None, 1, 5])) for _ in range(60)], "k string, w int")
    got = hot_keys.eager_join_aggregate(left, right, ["k"], ["g"], [hot_keys.Measure("sv", "left", F.col("v")), hot_keys.Measure("sw", "right", F.col("w"))])
    plain = left.join(right, "k").groupBy("g").agg(F.count(F.lit(1)).alias("joined_rows"), F.sum("v").alias("sv"), F.sum("w").cast("double").alias("sw"))
    assert sorted((r.g, r.joined_rows, round(r.sv, 6), float(r.sw)) for r in got.collect()) == sorted((r.g, r.joined_rows, round(r.sv, 6), r.sw) for r in plain.collect())


def test_rows_differ_by_nulls(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", "x", None), ("a", "", "x"), ("a", None, "x")], "k string, b string, c string")
    assert hot_keys.distinct_rows(df, ["k"], ["b", "c"]).count() == 3


def test_firsts_caps_and_names(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, k string, o int").repartition(4)
    want = {}
    for i, k, o in rows:
        want[k] = min(want.get(k, (o, i)), (o, i))
    assert {r.k: (r.o, r.i) for r in R.first_per_key(df, ["k"], ["o"]).collect()} == want
    capped = R.cap_per_group(df, ["k"], ["i"], 7).collect()
    assert Counter(r.k for r in capped) == {"a": 7, "b": 7, None: 7} and all(sum(x[0] < r.i for x in rows if x[1] == r.k) < 7 for r in capped)
    assert {r.k: r.skipped for r in R.skipped_by_cap(df, ["k"], 7).collect()} == {k: n - 7 for k, n in Counter(r[1] for r in rows).items()}
    assert [r.i for r in R.global_cap(df, ["i"], 10, 4).collect()] == [0, 1, 2, 3, 4, 5] and R.global_cap(df, ["i"], 0).count() == 100
    names = spark.createDataFrame([(1, "s", "a.png"), (2, "s", "a.png"), (3, "t", "a.png"), (4, "s", "b"), (5, "s", "b")], "i int, site string, name string")
    taken = spark.createDataFrame([("s", "a.png"), ("s", "a-2.png")], "site string, name string")
    assert [r.file_name for r in R.numbered_names(names, "site", "name", ["i"]).orderBy("i").collect()] == ["a.png", "a-2.png", "a.png", "b", "b-2"]
    assert [r.file_name for r in R.numbered_names(names, "site", "name", ["i"], taken).orderBy("i").collect()] == ["a-3.png", "a-4.png", "a.png", "b", "b-2"]
    clash = spark.createDataFrame([(1, "s", "a.png"), (2, "s", "a.png"), (3, "s", "a-2.png"), (4, "s", None), (5, "s", "a.png"), (6, "s", "a-4.png")], "i int, site string, name string")
    assert [r.file_name for r in R.numbered_names(clash, "site", "name", ["i"]).orderBy("i").collect()] == ["a.png", "a-3.png", "a-2.png", None, "a-5.png", "a-4.png"]
    dup = R.mark_duplicates(df.withColumn("h", F.col("o").cast("string")), "h", ["i"], spark.createDataFrame([("3",)], "h string")).collect()
    assert all(r.duplicate == (r.h == "3" or any(x[2] == r.o and x[0] < r.i for x in rows)) for r in dup)


def test_sets_and_domains(spark):
    df = spark.createDataFrame([("https://www.a.test/x",), ("https://b.test",), ("https://m.x.com/",), ("https://netflix.com",), (None,)], "url string")
    assert [r.url for r in R.in_scope(df, "url", spark.createDataFrame([(" WWW.A.test ",)], "h string")).collect()] == ["https://www.a.test/x"]
    hosts = df.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    assert [r.host for r in R.below_domain(hosts, "host", spark.createDataFrame([("x.com",), ("test",)], "d string")).orderBy("host").collect()] == ["b.test", "m.x.com", "www.a.test"]
    assert R.unseen(df, df.limit(0), ["url"]).count() == 5
    assert {tuple(r) for r in R.state_counts(spark.createDataFrame([(1,), (1,), (None,)], "state int")).collect()} == {(0, 0), (1, 2), (2, 0)}


def test_report_rows_sort_and_search(spark):
    rows = spark.createDataFrame([("Broken Link", d, "u", "f") for d in ("10", "9", "b", "A", " ", "")], "category string, detail string, url string, found_on string")
    assert [r.detail for r in R.sorted_rows(rows, "detail").collect()] == ["9", "10", "", " ", "A", "b"]
    assert R.search_rows(rows, "BROKEN").count() == 6 and R.search_rows(rows, "", ("x",)).count() == 0 and R.search_rows(rows, "9").count() == 1
    stats = spark.createDataFrame([("a.test", 3, 1, 0, None, "https://a.test/", '["x-frame-options", "referrer-policy"]'), ("b.test", 1, 0, 0, 0, None, '["cut'), ("c.test", 0, 0, 0, 0, None, None)],
                                  "netloc string, pages_crawled int, robots_blocked int, pattern_skipped int, query_skipped int, header_checked_url string, missing_headers string")
    found = spark.createDataFrame([(1, "a.test", "broken", "https://a.test/x", "404", "https://a.test/", None), (2, "a.test", "broken", "https://a.test/x", "404", "https://a.test/", None), (3, "a.test", "secret", "https://a.test/s", "AB**CD", None, "Key (high)"),
                                   (4, "a.test", "broken_resource", "https://a.test/</script>", "500", None, "image"), (5, "a.test", "scan_caveat", "https://a.test/", "shaky", None, None)], "id long, netloc string, category string, url string, detail string, found_on string, kind string")
    made = {(r.category, r.severity, r.detail) for r in reports.report_rows(found, stats).collect()}
    assert made == {("Broken Link", "critical", "404"), ("Possible Secret", "critical", "Key (high): AB**CD"), ("Broken Resource (image)", "critical", "500"), ("Scan Caveat", "warning", "shaky"), ("Missing Security Header", "warning", "x-frame-options"), ("Missing Security Header", "warning", "referrer-policy")}
    text = "".join(reports.text_report(found, stats, "a.test", datetime(2025, 1, 2, 3, 4, 5), partial=True))
    assert "PARTIAL" in text and "BROKEN LINKS (404/410/other errors) (1)\n" in text and "[404] https://a.test/x\n    found on: https://a.test/\n" in text and "a.test: shaky" in text and "None found." in text
    assert "Not checked" in "".join(reports.text_report(found, stats, "c.test", datetime(2025, 1, 1)))
    page = reports.html_report(reports.report_rows(found, stats), {"title": "a <b>"})
    assert "</script>\"" not in page.split('id="d">')[1].split("</script>")[0] and "a &lt;b&gt;" in page
    assert 'id="copy"' in page and "chips" in page
    assert json.loads(page.split('id="d">')[1].split("</script>")[0])["rows"][0]["category"] == "Broken Link"
    assert {r.netloc: r.findings for r in R.stats_and_findings(stats, found).collect()} == {"a.test": 5, "b.test": 0, "c.test": 0}


SITE = {
    "https://a.test/": '<a href="/about">x</a><a href="/x/1?d=1">1</a><a href="/x/1?d=2">2</a><a href="/x/1?d=3">3</a><a href="/news/1">n</a><a href="https://out.test/">o</a><script src="/s.js"></script><!-- sorry, this is a hack! --><p>five words stand in here</p>',
    "https://a.test/about": '<a href="/">home</a><a href="/deep">d</a> write to Me@a.test and logo@2x.png <p>five words stand in here</p>',
    "https://a.test/x/1?d=1": "", "https://a.test/x/1?d=2": "", "https://a.test/x/1?d=3": "", "https://a.test/news/1": '<a href="/news/2">n</a> me@a.test', "https://a.test/deep": '<a href="/deeper">d</a>', "https://a.test/deeper": "end", "https://a.test/news/2": "x",
}


def site(spark):
    return spark.createDataFrame([(u, h) for u, h in SITE.items()], "url string, body string").withColumn("headers", F.create_map(F.lit("Server"), F.lit("x/1")))


def test_crawl_reaches_resumes_and_caps(spark, tmp_path):
    limits = frontier.Limits(max_query_variants=2)
    whole = pipelines.crawl(spark, ["a.test"], site(spark), limits, f"file://{tmp_path}/whole")
    pages = {r.url: r.depth for r in whole.frontier().where("kind = 'page'").collect()}
    assert set(pages) == {u for u in SITE if not u.endswith("d=3")} | {"https://a.test/s.js"}
    assert pages["https://a.test/about"] == 1 and pages["https://a.test/deeper"] == 3
    assert whole.frontier().where("url LIKE '%out.test%'").first().kind == "external link"
    assert whole.frontier().groupBy("urlhash").count().where("count > 1").count() == 0

    part = frontier.Crawl(spark, ["a.test"], http.recorded(site(spark)), pipelines.expand_links(spark.createDataFrame([("a.test",)], "s string")), limits, f"file://{tmp_path}/part").run(waves=2)
    assert len(part.waves) == 3
    again = pipelines.crawl(spark, ["a.test"], site(spark), limits, f"file://{tmp_path}/part")
    assert {tuple(r) for r in again.frontier().select("url", "kind", "depth").collect()} == {tuple(r) for r in whole.frontier().select("url", "kind", "depth").collect()}
    try:
        pipelines.crawl(spark, ["b.test"], site(spark), limits, f"file://{tmp_path}/late")
        frontier.Crawl(spark, ["other.test"], http.recorded(site(spark)), pipelines.expand_links(), limits, f"file://{tmp_path}/late")
    except ValueError as why:
        assert "other seeds" in str(why)
    small = pipelines.crawl(spark, ["a.test"], site(spark), frontier.Limits(max_rows=4, max_depth=1), f"file://{tmp_path}/small")
    assert small.frontier().count() == 4 and {r.url for r in small.frontier().collect()} >= {"https://a.test/", "https://a.test/about"}

    found = {(r.category, r.url) for r in pipelines.deep_audit(whole).collect()}
    assert ("version_disclosure", "https://a.test/") in found and ("broken", "https://a.test/s.js") in found
    answers = whole.responses()
    got = {tuple(r) for r in pipelines.email_audit(answers.withColumn("seq", F.length("url"))).collect()}
    assert got == {("a.test", "me@a.test", "https://a.test/about")}
    assert [r.url for r in pipelines.corpus(answers).collect()] == ["https://a.test/"]
    assert [(r.kind, r.domain) for r in pipelines.hunt(answers, "2025-01-01T00:00:00").collect()] == [("html_comment", "a.test")]
    assert pipelines.header_stats(answers.join(whole.frontier().select("url", "depth"), "url")).first().missing_headers.startswith('["Content-Security-Policy"')


def test_best_first_waves_and_host_probes(spark, tmp_path):
    one = pipelines.crawl(spark, ["a.test"], site(spark), frontier.Limits(wave_size=1), f"file://{tmp_path}/one")
    rows = {r.url: r.wave for r in one.frontier().where("kind = 'page'").collect()}
    fetched = {r.url: n for n in one.waves[:-1] for r in spark.read.parquet(f"{one.path}/responses/wave={n}").collect()}
    assert set(rows) == {r.url for r in pipelines.crawl(spark, ["a.test"], site(spark), frontier.Limits(), f"file://{tmp_path}/all").frontier().where("kind = 'page'").collect()}
    assert fetched["https://a.test/about"] < fetched["https://a.test/deep"] < fetched["https://a.test/news/1"]
    pages = spark.createDataFrame([("https://a.test/robots.txt", "User-agent: *\nDisallow: /x"), ("https://a.test/nf-zz", "lost nf-zz page"), ("https://a.test/", "home"), ("https://b.test/nf-zz", "same"), ("https://b.test/", "same")], "url string, body string")
    roots = spark.createDataFrame([("https://a.test",), ("https://b.test",), ("https://c.test",), (None,)], "r string")
    assert [(r.root, r.pattern) for r in pipelines.robots_rules(roots, http.recorded(pages)).collect()] == [("https://a.test", "/x")]
    assert {r.host: r.mode for r in pipelines.soft404_profiles(roots, http.recorded(pages), "zz").collect()} == {"a.test": "soft200", "b.test": "spa", "c.test": "honest"}
    assert pipelines.email_report(spark.createDataFrame([("a.test", "x@a.test", "https://a.test/"), ("a.test", "b@a.test", "https://a.test/p")], "site string, email string, first_page string")).first().block == "a.test\n    b@a.test\n        found on: https://a.test/p\n    x@a.test\n        found on: https://a.test/\n  (2 email(s) found)"
    assert pipelines.with_progress(http.recorded(pages)(pages.select("url"))).count() == 5


def test_traversal_visits_each_node_once(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    depth, wave = {"n1": 0}, ["n1"]
    for d in range(1, 5):
        wave = [b for a, b in edges if a in wave and b not in depth]
        depth |= {b: d for b in wave}
    got = frontier.traverse(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n1",)], "node string"), 4)
    assert {r.node: r.depth for r in got.collect()} == depth


def test_files_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "seeds.txt").write_text("# note\n\n a.test \nb.test\n")
    assert files.seeds(spark, [f"{at}/seeds.txt"]) == ["a.test", "b.test"] and files.seeds(spark, ["x", " y "]) == ["x", "y"] and files.lines(spark, f"{at}/none").count() == 0
    words = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "w string")
    assert files.append_new_lines(words, "w", f"{at}/corpus") == 2 and files.append_new_lines(words, "w", f"{at}/corpus") == 0
    assert sorted(r.line for r in files.lines(spark, f"{at}/corpus").collect()) == ["a", "b"]
    find = lambda k, t, d: (k, t, "u", d, 3, ["x"], "2025-01-01T00:00:00")
    first = spark.createDataFrame([find("console", "A  b", "d1"), find("console", "a b", "d2"), find("humans_txt", "t", "d1"), find("humans_txt", "t", "d2")], files.FIND)
    files.add_finds(first, f"{at}/finds")
    files.add_finds(first, f"{at}/finds")
    (tmp_path / "finds" / "extra.json").write_text('{"kind": broken\n\n')
    assert files.finds(spark, f"{at}/finds").count() == 3
    more = lambda run: spark.createDataFrame([find("console", f"{run} {k}", "d9") for k in range(3)], files.FIND)
    for run in range(3):
        files.add_finds(more(run), f"{at}/capped", 5)
    assert files.finds(spark, f"{at}/capped").count() == 5  # 3 and 2, then none
    files.save_completed(spark, f"{at}/state.json", ["b", "a"])
    assert files.completed(spark, f"{at}/state.json") == ["a", "b"] and files.completed(spark, f"{at}/none.json") == []
    files.save_completed(spark, f"{at}/state.json", [])
    assert not (tmp_path / "state.json").exists()
    meta = files.upsert_meta(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"))
    assert {tuple(r) for r in meta.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (200).to_bytes(4, "big") * 2
    images = pipelines.image_scrape(spark.createDataFrame([(f"https://c.test/{n}.png", "https://a.test/p", 200, "image/png", b) for n, b in (("a", png), ("b", png), ("c/a", png + b"x"), ("s", png[:16] + (9).to_bytes(4, "big") * 2))],
                                                          "url string, found_on string, status int, content_type string, body binary"))
    rows = {r.image_url: (r.duplicate, r.file_name) for r in images.collect()}
    assert rows == {"https://c.test/a.png": (False, "a.png"), "https://c.test/b.png": (True, None), "https://c.test/c/a.png": (False, "a-2.png")}
    manifest = files.save_images(images.where("NOT duplicate"), str(tmp_path / "images"))
    assert manifest.count() == 2 and files.image_hashes(spark, str(tmp_path / "images")).count() == 2
    files.add_findings(findings_table(spark, n=20)[1], f"{at}/facts")
    assert spark.read.parquet(f"{at}/facts").where("detail IS NULL").count() == 0


def test_global_cap_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "ONE_TASK", 3)
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a int, b int").repartition(4)
    want = sorted((i % 7, i) for i in range(50))
    for most in (2, 10, 33, 80):
        assert sorted(tuple(r) for r in R.global_cap(df, ["a", "b"], most).collect()) == want[:most]


def test_caps_hold_over_waves_and_say_what_they_refused(spark, tmp_path):
    # a chain of pages, each with two more pages of one prefix, two queries of one path and a page of another host
    def page(k):
        return f'<a href="/c{k + 1}/x">n</a><a href="/p/{k}a">1</a><a href="/p/{k}b">2</a><a href="/p/0a">again</a><a href="/q?v={k}a">3</a><a href="/q?v={k}b">4</a><a href="https://b.test/{k}">5</a>' if k < 4 else ""

    pages = spark.createDataFrame([("https://a.test/" if not k else f"https://a.test/c{k}/x", page(k)) for k in range(5)], "url string, body string")
    limits = frontier.Limits(max_per_prefix=5, max_query_variants=3, allow_external=True)
    c = pipelines.crawl(spark, ["a.test"], pages, limits, f"file://{tmp_path}/caps")
    got = {r.url: r.depth for r in c.frontier().collect()}
    assert len(c.waves) == 6 and got["https://a.test/c4/x"] == 4
    assert {u for u in got if "/p/" in u} == {"https://a.test/p/0a", "https://a.test/p/0b", "https://a.test/p/1a", "https://a.test/p/1b", "https://a.test/p/2a"}
    assert {u for u in got if "/q?" in u} == {"https://a.test/q?v=0a", "https://a.test/q?v=0b", "https://a.test/q?v=1a"}
    # of p: 2b, 3a, 3b; of the prefix q: 2b, 3a, 3b; of the path q: 1b, 2a
    assert {r.netloc: (r.pattern_skipped, r.query_skipped) for r in c.skips().collect() if r.netloc == "a.test"} == {"a.test": (6, 2)}
    # occurrences: 0a and 0b; then 1a, 1b and 0a again fill the cap
    c = pipelines.crawl(spark, ["a.test"], pages, frontier.Limits(max_per_prefix=5, count_occurrences=True, allow_external=True), f"file://{tmp_path}/again")
    assert {r.url[-2:] for r in c.frontier().where("url LIKE '%/p/%'").collect()} == {"0a", "0b", "1a", "1b"}
    hosts = pipelines.crawl(spark, ["a.test"], pages, frontier.Limits(max_per_host=4, max_pages=6, allow_external=True), f"file://{tmp_path}/hosts", roam=True)
    fetched = Counter(r.url.split("/")[2] for r in hosts.responses().collect())
    assert fetched["a.test"] == 4 and sum(fetched.values()) == 6
    assert hosts.held().where("why = 'host_cap' AND url LIKE '%a.test%'").count() > 0
    three, more = (pipelines.crawl(spark, ["a.test"], pages, frontier.Limits(max_pages=n, allow_external=True), f"file://{tmp_path}/some", roam=True) for n in (3, 5))
    assert more.responses().count() == 5 and {r.url for r in more.pending().collect()} == {r.url for r in more.frontier().collect()} - {r.url for r in more.responses().collect()}
    assert more.pending().count() > 0


def test_roaming_takes_the_front_page_next_and_robots_hold_back(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.test/deep/1", '<a href="https://b.test/x">x</a><a href="https://b.test/y">y</a>'), ("https://a.test/", "home"), ("https://b.test/x", ""), ("https://b.test/y", ""), ("https://b.test/", "front"),
                                   ("https://b.test/robots.txt", "User-agent: *\nDisallow: /y")], "url string, body string")
    c = pipelines.crawl(spark, ["https://a.test/deep/1"], pages, pipelines.roaming(50, 2, home_first=True), f"file://{tmp_path}/roam", roam=True, robots_txt="wildcard")
    assert {r.url for r in c.responses().collect()} == {"https://a.test/deep/1", "https://a.test/", "https://b.test/x", "https://b.test/"}
    assert [tuple(r) for r in c.held().collect()] == [("https://b.test/y", "robots")]
    assert c.frontier().groupBy("urlhash").count().where("count > 1").count() == 0


def test_a_whole_audit(spark, tmp_path):
    pages = spark.createDataFrame([
        ("https://a.test/", '<a href="/lost">l</a><a href="/kept">k</a><img src="/gone.png"><img src="https://out.test/pic.png"><a href="https://www.facebook.com/x">f</a>', 200),
        ("https://a.test/lost", "No such thing here", 200), ("https://a.test/nf-tok", "No such thing here", 200), ("https://a.test/kept", "<p>kept</p>", 200), ("https://a.test/robots.txt", "User-agent: *\nDisallow: /none", 200),
        ("https://out.test/pic.png", "", 403), ("https://a.test/.env", "x=1", 200)], "url string, body string, status int").withColumn("headers", F.create_map(F.lit("Server"), F.lit("x/1")))
    c, found, stats = pipelines.whole_audit(spark, ["a.test"], pages, path=f"file://{tmp_path}/audit", probe=True, token="tok")
    rows = {(r.category, r.url, r.kind) for r in found.collect()}
    assert rows == {("broken_resource", "https://a.test/gone.png", "image"), ("unverified_resource", "https://out.test/pic.png", "image"), ("unverified_resource", "https://www.facebook.com/x", "external link"),
                    ("broken", "https://a.test/lost", None), ("exposed_path", "https://a.test/.env", None), ("version_disclosure", "https://a.test/", None)}
    s = stats.where("netloc = 'a.test'").first()
    assert (s.pages_crawled, s.robots_blocked, s.pattern_skipped, s.header_checked_url) == (3, 0, 0, "https://a.test/")


def test_finds_of_hosts_and_totals(spark):
    pages = spark.createDataFrame([("https://a.test/1", "<!-- sorry, this is a hack! -->"), ("https://a.test/2", '<img src="/a.png" srcset="/a.png 1x, /b.png 2x">'), ("https://a.test/humans.txt", "made by two people in a barn")], "url string, body string")
    answers = http.recorded(pages)(pages.where("url NOT LIKE '%humans%'"))
    made = pages.withColumn("content_type", F.when(F.col("url").endswith(".txt"), "text/plain").otherwise("text/html"))
    got = pipelines.hunt(answers, "2025-01-01T00:00:00", 25, http.recorded(made)).collect()
    assert {(r.kind, r.url) for r in got} == {("html_comment", "https://a.test/1"), ("humans_txt", "https://a.test/humans.txt")}
    assert {tuple(r) for r in pipelines.image_links(answers).collect()} == {("https://a.test/a.png", "https://a.test/2"), ("https://a.test/b.png", "https://a.test/2")}
    images = spark.createDataFrame([("s", True), ("s", False), ("t", False)], "site string, duplicate boolean")
    assert {tuple(r) for r in pipelines.image_totals(images).collect()} == {("s", 1, 1), ("t", 1, 0)}
    assert tuple(pipelines.corpus_totals(images, images.limit(2)).first()) == (3, 2, 1)
    page = reports.gallery(spark.createDataFrame([("console", "hi there", "u", "d", 3, ["x"], "2025-01-01")], files.FIND), datetime(2025, 1, 1))
    assert "hi there" in page


def test_gallery_and_probes(spark):
    finds = spark.createDataFrame([(i, rng_kind, f"<t{i}>", "u", "d", i % 7, ["x"], "2025") for i, rng_kind in enumerate(["console", "header", None] * 5)], "find_id long, kind string, text string, url string, domain string, score int, tags array<string>, ts string")
    page = reports.gallery(finds, datetime(2025, 1, 1))
    assert "&lt;t13&gt;" in page and "5 console message" in page and "<t13>" not in page
    probes = pipelines.probe_targets(spark, spark.createDataFrame([("https://a.test",), ("https://b.test",), ("https://a.test",)], "r string"))
    assert probes.count() == 2 * len(rules.COMMON_PROBE_PATHS)


def test_fetching_goes_by_host():
    groups = http.by_host([f"https://h{i % 5}.test/{i}" for i in range(50)], 3)
    assert len(groups) == 3 and sum(map(len, groups)) == 50 and all(len({g for g, own in enumerate(groups) if any(f"//h{i}." in u for u in own)}) == 1 for i in range(5))
    assert [http.cooldown(1, None), http.cooldown(3, "x"), http.cooldown(1, "90"), http.cooldown(2, "5")] == [2.0, 8.0, 60.0, 5.0]
    assert http.cookie_row("sid=1; Secure; SameSite=Lax") == ("sid", True, False, True)
    f = http.Fetcher({"delayMin": 0, "delayMax": 0})
    slept = []
    f.sleep = slept.append

    class Answer:
        headers, url = {"Retry-After": "7"}, "u"

        def __init__(self, status):
            self.status = status

        def read(self, n):
            return b""

    answers = iter([Answer(429), Answer(503), Answer(200)])
    f.opened = lambda url, method: next(answers)
    assert f.get("https://a.test/x")[0].status == 200 and [s for s in slept if s] == [7.0, 7.0]


def test_network_source_over_loopback(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path != "/gone" else 404)
            self.send_header("Content-Type", "text/html")
            self.send_header("Set-Cookie", "a=b; HttpOnly")
            self.end_headers()
            self.wfile.write(b"<p>hello</p>")

        def do_HEAD(self):
            self.send_response(405)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    http.register(spark)
    options = {"urls": f"{base}/\n{base}/gone", "delayMin": "0", "delayMax": "0", "maxRetries": "0"}
    rows = {r.url: r for r in spark.read.format("http_pages").options(**options).load().collect()}
    assert rows[f"{base}/"].status == 200 and rows[f"{base}/"].body == "<p>hello</p>" and rows[f"{base}/gone"].status == 404 and rows[f"{base}/"].cookies[0].httponly
    assert {r.url: r.status for r in spark.read.format("http_status").options(**options).load().collect()} == {f"{base}/": 200, f"{base}/gone": 404}
    assert spark.read.format("http_binary").options(**options).load().where("status = 200").first().body == b"<p>hello</p>"
    server.shutdown()


def test_streams(spark, tmp_path):
    offers = spark.createDataFrame([(1, None, "https://a.test/?utm_id=1", "page", datetime(2025, 1, 1, 10)), (2, None, "https://A.test/", "image", datetime(2025, 1, 1, 10, 5)), (3, None, None, "page", None), (4, "0" * 40, None, "page", datetime(2025, 1, 1, 12))],
                                   "offer_id long, urlhash string, url string, kind string, offered_at timestamp")
    offers.write.parquet(f"{tmp_path}/in")
    stream = lambda: jobs.read_offers(spark, f"{tmp_path}/in", offers.schema)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert len(run(jobs.first_offers(stream()), "firsts", "append")) == 2
    assert sum(r.offers for r in run(jobs.offers_per_window(stream()), "windows", "complete")) == 3
    answers = spark.createDataFrame([("h", 429, None), ("h", 429, 30.0), ("h", 200, None), ("h", 503, None), ("k", 200, None)], "host string, status int, retry_after double")
    timed = spark.createDataFrame([("h", 200, None, 3), ("h", 429, None, 1), ("h", 503, None, 4), ("h", 429, 30.0, 2)], "host string, status int, retry_after double, at int")
    timed.coalesce(1).write.parquet(f"{tmp_path}/timed-in")
    rows = run(jobs.throttle(spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/timed-in")), "timed", "append")
    assert [(r.status, r.streak, r.wait) for r in rows] == [(429, 1, 2.0), (429, 2, 30.0), (200, 0, 0.0), (503, 1, 2.0)]
    answers.coalesce(1).write.parquet(f"{tmp_path}/answers")
    rows = run(jobs.throttle(spark.readStream.schema(answers.schema).parquet(f"{tmp_path}/answers")), "waits", "append")
    assert [(r.status, r.streak, r.wait) for r in rows if r.host == "h"] == [(429, 1, 2.0), (429, 2, 30.0), (200, 0, 0.0), (503, 1, 2.0)]
    q = jobs.append_new(stream().where("url IS NOT NULL"), "url", f"file://{tmp_path}/lines", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert files.lines(spark, f"file://{tmp_path}/lines").count() == 2
    seen = []
    q = jobs.checkpointed_report(stream(), lambda df, n: seen.append(df.count()), f"{tmp_path}/store", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [4]


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_deep_crawl_keeps_its_order(spark, tmp_path):
    # the place of a page far down must fit its number, and follow the places of its parents
    roots = [f"s{k}.test" for k in range(5)]
    pages = {f"https://{s}/" if not k else f"https://{s}/c{k}": f'<a href="/c{k + 1}">n</a>' for s in roots for k in range(6)}
    df = spark.createDataFrame(list(pages.items()), "url string, body string").withColumn("headers", F.create_map(F.lit("Server"), F.lit("x/1"))).repartition(3)
    got = pipelines.crawl(spark, roots, df, path=f"file://{tmp_path}/deep").frontier().where("depth = 6").orderBy("seq").collect()
    assert [r.url for r in got] == [f"https://{s}/c6" for s in roots]


def test_graph_and_domain_queries_read_whole_tables(spark, tmp_path):
    rng = random.Random(7)
    lines = [(rng.choice([1, 399, 400, 90_000]), rng.randrange(40), rng.randrange(1, 12)) for _ in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    near: dict = {}
    for _, p, s in lines:
        near.setdefault(f"p{p}", set()).add(f"s{s}")
        near.setdefault(f"s{s}", set()).add(f"p{p}")
    depth, wave = {"s1": 0}, ["s1"]
    for d in range(1, 4):
        wave = {b for a in wave for b in near.get(a, ())} - set(depth)
        depth |= dict.fromkeys(wave, d)
    assert {r.node: r.depth for r in queries.QUERIES["frontier_bfs"](spark, str(tmp_path)).collect()} == depth

    hosts = ["a.example", "x.b.test", "b.test", "deep.c.invalid", "notb.test", "d.example"]
    offers = [(i, "page", f"https://{h}/p", None, 0, 0) for i, h in enumerate(hosts)]
    spark.createDataFrame(offers, "offer_id long, kind string, url string, source string, depth int, state int").write.parquet(f"{tmp_path}/frontier.parquet")
    spark.createDataFrame([("a.example",), ("b.test",), ("c.invalid",)], "netloc string").write.parquet(f"{tmp_path}/site_stats.parquet")
    assert sorted(r.offer_id for r in queries.QUERIES["hosts_below_domains"](spark, str(tmp_path)).collect()) == [0, 1, 2, 3]


def test_the_six_tools(spark, tmp_path):
    from quarrylight import cli

    png = "\x89PNG"  # bytes are recorded as text here: no image large enough
    rows = [("https://a.test/", '<a href="/b">b</a><a href="/gone">g</a><a href="/list.pdf">l</a><img src="/x.png"><p>five words stand in here</p><!-- sorry, this is a hack! --> me@a.test', "text/html"),
            ("https://a.test/b", "<p>six other words stand in here</p>", "text/html"), ("https://a.test/list.pdf", "", "application/pdf"), ("https://a.test/x.png", png, "image/png")]
    spark.createDataFrame(rows, "url string, body string, content_type string").write.parquet(f"{tmp_path}/pages")
    run = lambda tool, *more: cli.main([tool, "a.test", "--pages", f"{tmp_path}/pages", "--output-dir", f"{tmp_path}/{tool}", *more], spark)
    got = run("quick")
    assert (got["pages_crawled"], got["broken"], got["flagged"]) == (4, 1, 1)
    assert "https://a.test/gone" in (tmp_path / "quick" / "quick_scan_report.txt").read_text() and '"category":"Broken"' in (tmp_path / "quick" / "quick_scan_report.html").read_text()
    got = run("audit", "--no-soft-404", "--max-depth", "1")
    assert got["reports"] == 1 and "[404] https://a.test/gone" in (tmp_path / "audit" / "a.test.txt").read_text()
    assert run("emails")["unique_emails"] == 1 and "me@a.test" in (tmp_path / "emails" / "email_audit_report.txt").read_text()
    assert run("images", "--min-width", "0", "--min-height", "0")["images_downloaded"] == 1 and (tmp_path / "images" / "images" / "a.test" / "x.png").exists()
    got = run("corpus", "--ignore-robots", "--max-pages", "1")
    assert (got["pages_fetched"], got["new_paragraphs"], got["waiting"]) == (1, 1, 3)
    assert run("hunt")["finds"] == 1 and "this is a hack" in (tmp_path / "hunt" / "gallery.html").read_text()
