"""Column functions against independent statements of their results."""

import hashlib
import math
import random
import struct
from urllib.parse import urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import html, images, responses, robots, secrets, urls
from quarrylight.functions import text as T


def values(spark, inputs, expression, schema="x string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r[0] for r in df.select("i", expression.alias("v")).orderBy("i").select("v").collect()]


def spec_canonical(url):
    p = urlparse(url)
    host = p.netloc.lower()
    for s, port in (("http", ":80"), ("https", ":443")):
        if p.scheme.lower() == s and host.endswith(port):
            host = host[:-len(port)]
    path = p.path
    while "//" in path:
        path = path.replace("//", "/")
    kept = sorted(kv for kv in p.query.split("&") if kv and kv.split("=")[0].lower() not in rules.TRACKING_PARAMS)
    return urlunparse((p.scheme.lower(), host, path or "/", p.params, "&".join(kept), ""))


def test_canonical_addresses(spark):
    rng = random.Random(1)
    seen = ["HTTP://A.Example.COM:80//x?b=2&utm_source=z&a=1#f", "/foo/", "https://h:443/a//b///c/?q=", "http://h", "https://h?x=1", "mailto:a@b.c", "http://h/a;p=1/b;q=2?b&a&a", "//h/x", "", "http://h/?&&a=1&",
            "https://h/?UTM_Source=1&b=%20", "http://h/a\tb\nc", "  http://h/x", "http://h/x;", "https://h:80/", "foo?b=1&a=2", "http:///x"]
    seen += [f"{rng.choice(['http', 'HTTPS', 'ftp'])}://{rng.choice(['A.b', 'www.x.y:80', 'q:443'])}{rng.choice(['', '/', '//a//b', '/a;b=c'])}{rng.choice(['', '?z=1&gclid=3&a=2', '?#', '?b=1&b=1'])}{rng.choice(['', '#top'])}" for _ in range(150)]
    got = values(spark, seen, urls.canonical(F.col("x")))
    assert got == [spec_canonical(u) for u in seen]
    assert values(spark, got, urls.canonical(F.col("x"))) == got
    assert values(spark, [None, "http://[h/x"], urls.canonical(F.col("x"))) == [None, "http://[h/x"]


def test_offered_keys(spark):
    url, h = "https://A.test/x?utm_source=1", hashlib.sha1(b"https://a.test/x").hexdigest()
    assert values(spark, [(f" {h.upper()}\n", None), (None, url), (h[:39], url), ("zz", None), (None, None), (h + "0", url)], urls.offered_key(F.col("a"), F.col("b")), "a string, b string") == [h, h, h, None, None, h]


def test_forms_of_an_address(spark):
    u = "https://WWW.www.Shop.test:8080/A/b;p=1?q=2#f"
    row = spark.createDataFrame([(u,)], "u string").select(urls.site_key(F.col("u")), urls.without_query(F.col("u")), urls.roaming_form(F.col("u")), urls.homepage(F.col("u")), urls.path_prefix(F.col("u"), 1),
                                                           urls.path(F.col("u")), urls.site_file_stem(urls.site_key(F.col("u"))), urls.with_scheme(F.lit("a.test"))).first()
    assert list(row) == ["www.shop.test:8080", "https://www.shop.test:8080/A/b", "https://www.www.shop.test:8080/A/b?q=2", "https://www.www.shop.test:8080/", "A", "/A/b", "www.shop.test_8080", "https://a.test"]
    odd = ["http://h/a;x/b", "http://h/a;x/b;y", "http://h/;", "http://h/a/;p", "http://h/a;b;c", "x:a;b"]
    assert values(spark, odd, urls.path(F.col("x"))) == [urlparse(u).path for u in odd]
    assert values(spark, ["http://h", "http://h/", None], urls.path_prefix(F.col("x"))) == ["", "", None]


def test_resolving_follows_the_standard(spark):
    base = "https://h.test/a/b/c?x=1"
    hrefs = ["d", "../d", "/e#f", "?y=2", "#top", "", "//k.test/z", "http://k.test/a/../b", "http://k.test/x#y", "mailto:a@b.c", "javascript:x()", "HTTP://K.test/q", "./", "https://k.test", None]
    want = [None if h is None or not (j := urljoin(base, h).split("#")[0]).startswith(("http://", "https://")) else j for h in hrefs]
    assert values(spark, hrefs, urls.resolve(F.lit(base), F.col("x"))) == want


def test_what_addresses_say(spark):
    p = "https://h.test"
    assert values(spark, [p + x for x in ("/contact", "/about/blog", "/blog/x", "/x", "")], urls.link_priority(F.col("x"))) == [1, 1, 3, 2, 2]
    assert values(spark, [p + x for x in ("/db.sql", "/users_export.csv", "/sitemap.xml", "/manifest.json", "/data.json", "/a.ZIP;v=1", "/x")], urls.sensitive_verdict(F.col("x"))) == ["high", "context", None, None, None, "high", None]
    assert values(spark, [p + x for x in ("/a.pdf;v=1", "/a.PPTX", "/pdf", "/a.pdf/x")], urls.legacy_file(F.col("x"))) == [True, True, False, False]
    assert values(spark, ["www.facebook.com", "m.x.com", "netflix.com", "x.com", ""], urls.bot_hostile(F.col("x"))) == [True, True, False, True, False]
    got = values(spark, [p + "/?" + q for q in ("next=https://e.test", "f=../../x", "p=/etc/passwd", "debug=1", "id=5&page=2", "debug=0", "q=a%2Fb+c%zz", "u=%2e%2e%2fx&test=ON")], urls.risky_params(F.col("x")))
    assert [len(g) for g in got] == [1, 1, 1, 1, 0, 0, 0, 2]
    assert got[0] == ["next= points at a URL (https://e.test) - open-redirect/SSRF candidate"] and got[3] == ["debug=1 - debug/admin toggle enabled"]


def test_emails_comments_and_art(spark):
    assert values(spark, ["A.B@Mail.Example.com, a.b@mail.example.com logo@2x.png", "", None, "x@y"], T.emails(F.col("x"))) == [["a.b@mail.example.com"], [], None, []]
    texts = ["sorry, this is a hack, no idea why it works!", "end header", "wp:paragraph hiring now please", "AVERAGE insights loops through", "v1.2.3 Licence MIT, join us", "we're hiring!", "<div>join us</div>", "modified: <300 items", None,
             "/\\/\\/\\/\\\n|  --  |\n\\______/\nx", "look (╯° wp:", "normal\nlines\nhere\nof words", "TODO for now it's my thing?!"]
    got = values(spark, texts, T.classify_comment(F.col("x")))
    assert [g and (g.kind, g.score) for g in got] == [("html_comment", 12), None, None, None, None, ("html_comment", 6), None, None, None, ("ascii_art", 6), ("ascii_art", 6), None, ("html_comment", 5)]
    assert got[0].tags == ["confession", "dev-voice"] and got[12].tags == ["note"]
    assert values(spark, ["rage in average, rage", "secretary", "wtf?"], T.keyword_count(F.col("x"), rules.STRONG_DEV)) == [2, 0, 1]
    assert values(spark, [("humans_txt", "x", "d"), ("console", " A  b\n" + "c" * 400, "d")], T.find_key(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string") == ["humans_txt\x00d", ("console\x00a b " + "c" * 400)[:308]]
    assert values(spark, ["<a href='x'>&\"</a>"], T.escape(F.col("x"))) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;"]


def test_secrets(spark):
    words = ["", "a", "password", "aZ3$x", None]
    entropy = lambda s: None if s is None else 0.0 if not s else -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))
    for got, want in zip(values(spark, words, secrets.shannon_entropy(F.col("x"))), map(entropy, words)):
        assert got == want or got == pytest.approx(want)
    assert values(spark, ["", "short", "12345678", "123456789ab"], secrets.mask(F.col("x"))) == ["", "*****", "********", "1234***89ab"]
    rng = random.Random(3)
    key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyz23456789") for _ in range(40))
    aws = "AKIA" + "Q7WZ1234567KLMNB"
    google = "AIza" + "Qw3" * 11 + "Zz"
    body = f'api_key = "{key}" password="password" api_key: "your_api_key_here_xx" {aws} {aws} {google}'
    df = spark.createDataFrame([("https://h.test/a", "h.test", body), ("https://h.test/b", "h.test", None)], "url string, netloc string, body string")
    got = {(r.category, r.kind, r.detail) for r in secrets.scan(df).collect()}
    assert got == {("secret", "Generic API Key/Secret Assignment (medium)", key[:4] + "*" * 32 + key[-4:]), ("secret", "AWS Access Key ID (high)", aws[:4] + "*" * 12 + aws[-4:]), ("secret_info", "Google API Key (info)", "AIza" + "*" * 31 + google[-4:])}
    assert values(spark, ["xxxxxxxxxxxx", "abab", "example-key", "x123456y"], secrets.placeholder(F.col("x"), False)) == [True, True, True, False]


def test_status_classes(spark):
    s = "status int, error string"
    assert values(spark, [(404, None), (410, None), (403, None), (500, None), (418, None), (429, None), (503, None), (200, None), (None, "timed out")], responses.page_class(F.col("status"), F.col("error")), s) == [
        "broken", "broken", "security_code", "security_code", "broken", "rate_limited", "rate_limited", None, "broken"]
    rows = [(403, None, "https://cdn.test/x"), (403, None, "https://www.a.test/x"), (404, None, "https://cdn.test/x"), (429, None, "https://cdn.test/x"), (999, None, "https://m.facebook.com/x"), (200, None, "https://a.test"), (None, "dns", "https://a.test")]
    assert values(spark, rows, responses.resource_class(F.col("status"), F.col("error"), F.col("u"), F.lit("https://a.test/p")), s + ", u string") == ["unverified_resource", "broken_resource", "broken_resource", "rate_limited", "unverified_resource", None, "broken_resource"]
    assert values(spark, [(404, 200), (404, 404), (429, 200), (200, None)], responses.confirmed_status(F.col("a"), F.col("b")), "a int, b int") == [200, 404, 429, 200]
    assert values(spark, ["5", " 2.5 ", "-1", "Wed, 21 Oct", None], responses.retry_after(F.col("x"))) == [5.0, 2.5, 0.0, None, None]
    assert values(spark, [(1, None), (3, None), (9, None), (1, 30.0), (1, 99.0)], responses.cooldown(F.col("a"), F.col("b")), "a int, b double") == [2.0, 8.0, 60.0, 30.0, 60.0]
    assert values(spark, [0, 2, 5], responses.transient_backoff(F.col("x")), "x int") == [1.0, 4.0, 8.0]
    assert values(spark, [200, 403, 404, 503], responses.probe_detail(F.col("x")), "x int") == ["200 reachable", "403 present but protected", None, None]


def test_headers_and_cookies(spark):
    df = spark.createDataFrame([({"server": "nginx/1.2", "X-Powered-By": "PHP", "Via": "proxy", "x-frame-options": "DENY", "X-Joke": "we love cats here", "X-Cache": "some words here", "X-Clacks-Overhead": "GNU"},)], "h map<string,string>")
    r = df.select(responses.missing_security_headers(F.col("h")), responses.version_disclosure(F.col("h")), responses.header_eggs(F.col("h")), responses.cookie_flags(F.lit("sid"), F.lit(True), F.lit(False), F.lit(False))).first()
    assert r[0] == ["Content-Security-Policy", "X-Content-Type-Options", "Strict-Transport-Security", "Referrer-Policy"]
    assert r[1] == "Server: nginx/1.2; X-Powered-By: PHP" and sorted(r[2]) == ["X-Clacks-Overhead: GNU", "X-Joke: we love cats here"] and r[3] == "cookie 'sid' missing: HttpOnly, SameSite"
    assert values(spark, [(200, "text/plain", " made with care by people "), (404, "text/plain", "x" * 30), (200, "text/html", "x" * 30), (200, None, "<HTML> not found page here"), (200, None, "short")],
                  responses.humans_txt(F.col("s"), F.col("c"), F.col("b")), "s int, c string, b string") == ["made with care by people", None, None, None, None]


def test_soft_404(spark):
    sig = lambda u, b: T.body_signature(F.lit(b), F.lit(u))
    a, b = spark.range(1).select(sig("https://h/abc", "Page /abc not  found"), sig("https://h/other", "page /OTHER not found")).first()
    assert a == b
    args = [F.col(c) for c in ("status", "error", "redirected", "final", "body", "hs", "hb")]
    rows = [(404, None, False, "https://h/nf", "x", 200, "home"), (200, None, True, "https://h/", "x", 200, "home"), (200, None, True, "https://h/404", "x", 200, "home"), (200, None, False, "https://h/nf", "home", 200, "home"), (200, None, False, "https://h/nf", "gone /nf", 200, "home")]
    profile = responses.soft404_profile(*args, F.lit("https://h"))
    got = values(spark, rows, profile, "status int, error string, redirected boolean, final string, body string, hs int, hb string")
    assert [g["mode"] for g in got] == ["honest", "rootredir", "redirect", "spa", "soft200"]
    p = F.struct(F.lit("redirect").alias("mode"), F.lit("https://h/404").alias("landing"), F.lit(None).cast("string").alias("sig"))
    assert values(spark, ["https://h/x", "https://h/404"], responses.soft404_reason(p, F.col("x"), F.lit("https://h/404"), F.lit(True), F.lit(None).cast("string"))) == ["redirects to https://h/404 (this site's not-found page)", None]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /search*\nAllow: /search/ok # note\nDisallow:\nDisallow: /a.b$\nUser-agent: other\nDisallow: /\nUser-Agent: *\nDisallow: /p?x=\nbad line"
    rows = robots.parse(spark.createDataFrame([("https://h.test", body), ("https://e.test", None)], "root string, body string"))
    assert [r.pattern for r in rows.orderBy("ord").collect()] == ["/search*", "/search/ok", "/a.b$", "/p?x="]
    paths = {"/search?q=1": False, "/search/ok/1": True, "/x": True, "/a.b": False, "/a.bc": True, "/aXb": True, "/p?x=1": False, "": True}
    pages = spark.createDataFrame([(f"https://h.test{p}",) for p in paths] + [("https://e.test/search",)], "url string")
    got = {r.url: r.allowed for r in robots.allowed(pages, rows).collect()}
    assert got == {f"https://h.test{p}": v for p, v in paths.items()} | {"https://e.test/search": True}
    assert values(spark, [("User-agent: *\nDisallow: /x", "https://h/x/1"), (None, "https://h/x"), ("", "https://h/x")], robots.standard_allowed(F.col("a"), F.col("b")), "a string, b string") == [False, True, True]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 50, 70)
    gif = b"GIF89a" + struct.pack("<HH", 300, 2)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"abcd" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 120, 340) + b"\0" * 12
    got = values(spark, [png, gif, jpeg, png[:20], b"RIFFxxxx", b"", b"\xff\xd8\xff", None], images.dimensions(F.col("x")), "x binary")
    assert [g and (g.width, g.height) for g in got] == [(50, 70), (300, 2), (340, 120), None, None, None, (None, None), None]
    names = [("https://h/a/pic.jpg?fm=webp", "image/webp"), ("https://h/a/pic.JPEG", "image/jpeg; x"), ("https://h/", "image/png"), ("https://h/x", ""), ("https://h/x.tar.gz", "text/plain"), ("https://h/.htaccess", "image/gif")]
    assert values(spark, names, images.file_name(F.col("u"), F.col("c")), "u string, c string") == ["pic.webp", "pic.JPEG", "image.png", "x", "x.tar.gz", ".htaccess.gif"]


PAGE = """<html><head><link rel="stylesheet icon" href="/s.css"><link rel=canonical href="http://a.test/c"><script src="//cdn.test/x.js"></script>
<script>console.log("%cwelcome to our site, hello there"); console.log("error loading"); var s = "<p>no</p>";</script></head>
<body><nav><p>menu words are not content at all</p></nav><p>one two three <b>four</b> five<br>six<p>seven eight nine ten eleven
<a href="../up#x">u</a><a href="http://www.a.test/in" target=_BLANK>i</a><a href="https://out.test/" target="_blank">o</a><a href="https://safe.test/" target="_blank" rel="noopener">o</a><a href="mailto:x@y.z">m</a>
<img src="http://a.test/i.png" srcset="/i2.png 2x, /i3.png#f 3x"><iframe src="/f"></iframe><form action="http://a.test/post"></form></body><!-- a comment -->"""


def test_html(spark):
    pages = spark.createDataFrame([("https://a.test/d/p", PAGE), ("https://a.test/d/q", PAGE), ("https://b.test", None), ("https://c.test", "")], "url string, html string")
    parsed = html.elements(pages).cache()
    one = parsed.where("url = 'https://a.test/d/p'")
    assert {(r.target, r.kind) for r in html.links(one).collect()} == {("https://a.test/up", "page"), ("http://www.a.test/in", "page"), ("https://out.test/", "page"), ("https://safe.test/", "page"), ("https://a.test/s.css", "stylesheet"),
                                                                       ("https://cdn.test/x.js", "script"), ("http://a.test/i.png", "image"), ("https://a.test/f", "iframe")}
    scope = spark.createDataFrame([("WWW.a.test",)], "site string")
    assert {(r.target, r.kind) for r in html.links(one, scope).collect() if "out" in r.target or "in" in r.target} == {("https://out.test/", "external link"), ("http://www.a.test/in", "page")}
    assert sorted(r.target for r in html.srcset_urls(one).collect()) == ["https://a.test/i2.png", "https://a.test/i3.png#f"]
    assert [r.paragraph.split()[0] for r in html.paragraphs(one).orderBy("ord").collect()] == ["one", "seven"]
    assert html.paragraphs(one).orderBy("ord").first().paragraph.startswith("one two three four five six seven")
    assert html.paragraphs(html.elements(pages, implied=True)).where("url LIKE '%/p'").orderBy("ord").first().paragraph == "one two three four five six"
    assert [r.message for r in html.console_eggs(one).collect()] == ["welcome to our site, hello there"]
    assert {(r.url, r.found_on) for r in html.mixed_content(parsed).collect()} == {(u, "https://a.test/d/p") for u in ("http://a.test/c", "http://a.test/i.png", "http://a.test/post")}
    assert [r.detail for r in html.third_party_scripts(parsed).collect()] == ["external script host: cdn.test"]
    assert [r.url for r in html.tabnabbing(parsed).collect()] == ["https://out.test/"]
    assert values(spark, [PAGE, "<!-- a --> x <!--b\nc-->"], T.html_comments(F.col("x"))) == [[" a comment "], [" a ", "b\nc"]]
    assert values(spark, ["<title> Index of /x", "<h1 class=a>INDEX OF /", "Directory listing for /", "index of"], responses.directory_listing(F.col("x"))) == [True, True, True, False]
