"""HTML as rows: one pass of the standard parser over each page, inside Arrow batches.

``elements`` turns pages into rows of the elements and texts the detectors ask for; everything
after it (resolving, scoping, classifying, first-per-site) is plain columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import text as T
from quarrylight.functions import urls

#: Elements that never hold others, and those whose paragraphs are no content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = frozenset(("nav", "header", "footer", "aside", "script", "style"))
_ATTRIBUTES = ("href", "src", "srcset", "action", "data", "rel", "target")


class _Walk(HTMLParser):
    """Elements with the attributes asked for, paragraphs and inline scripts of one page.

    An end tag closes the nearest open element of its name and all within it; one without such an
    element is ignored; an unclosed paragraph holds what follows it, unless ``implied`` closes it
    at the next.
    """

    def __init__(self, implied: bool):
        super().__init__(convert_charrefs=True)
        self.implied, self.open, self.rows, self.paragraphs = implied, [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in reversed(attrs) if k in _ATTRIBUTES}
        if found:
            self.rows.append((tag, found, None))
        if tag == "p":
            if self.implied:
                self._close("p")
            if not NOT_CONTENT.intersection(t for t, _ in self.open):
                part: list[str] = []
                self.paragraphs.append(part)
                self.open.append((tag, part))
                return
        if tag not in VOID:
            self.open.append((tag, [] if tag == "script" and not found.get("src") else None))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in reversed(attrs) if k in _ATTRIBUTES}
        if found:
            self.rows.append((tag, found, None))

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def _close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for t, part in self.open[k:]:
                    if t == "script" and part:
                        self.rows.append(("script", {}, "".join(part)))
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            if self.open[-1][1] is not None:
                self.open[-1][1].append(data)
            return
        for tag, part in self.open:
            if tag == "p" and part is not None:
                part.append(data)

    def finish(self) -> list[tuple[str, dict, str | None]]:
        self.close()
        for t, part in self.open:
            if t == "script" and part:
                self.rows.append(("script", {}, "".join(part)))
        return self.rows + [("p", {}, " ".join(" ".join(x.split()) for x in part if x.strip())) for part in self.paragraphs]


_SCHEMA = "url string, ord int, tag string, attrs map<string,string>, text string"


def elements(pages: DataFrame, url: str = "url", html: str = "html", implied: bool = False) -> DataFrame:
    """(url, ord, tag, attrs, text) of pages: elements with link attributes, inline scripts, paragraphs in content.

    Pages that are NULL or empty have no rows; broken markup gives what the parser makes of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h:
                    walk = _Walk(implied)
                    try:
                        walk.feed(h)
                        rows = walk.finish()
                    except AssertionError:  # the parser's own limit on broken declarations
                        rows = walk.rows
                    out += [(u, k, t, list(a.items()), x) for k, (t, a, x) in enumerate(rows)]
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["url", "ord", "tag", "attrs", "text"])

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, _SCHEMA)


def _attr(name: str) -> Column:
    return F.element_at("attrs", F.lit(name))


def links(parsed: DataFrame, scope: DataFrame | None = None, allow_external: bool = False) -> DataFrame:
    """(url, target, kind, ord) of the references of pages; kind ``page`` for what is to be crawled.

    Without ``scope`` every anchor is a page; with it (a table of sites) anchors and scripts of
    those sites are, and others are ``external link`` and ``script`` resources. Images,
    stylesheets, icons and frames are resources. Page links come once a page, in the place of the
    first of them; resources as often as they stand.
    """
    rel = F.lower(F.coalesce(_attr("rel"), F.lit("")))
    href = (F.when(F.col("tag").isin("a", "link"), _attr("href")).when(F.col("tag").isin("img", "iframe", "script"), _attr("src")))
    kind = (F.when(F.col("tag") == "a", "page").when(F.col("tag") == "img", "image").when(F.col("tag") == "iframe", "iframe").when(F.col("tag") == "script", "script")
            .when((F.col("tag") == "link") & (rel.contains("stylesheet") | rel.contains("icon")), "stylesheet"))
    found = parsed.select("url", "ord", href.alias("href"), kind.alias("kind")).where("href IS NOT NULL AND kind IS NOT NULL")
    found = found.select("url", urls.resolve(F.col("url"), F.col("href")).alias("target"), "kind", "ord").where("target IS NOT NULL")
    if scope is not None:
        sites = scope.select(urls.site_form(F.col(scope.columns[0])).alias("_site"), F.lit(True).alias("_in")).distinct()
        found = found.withColumn("_site", urls.site_key(F.col("target"))).join(sites, "_site", "left")
        inside = F.coalesce("_in", F.lit(allow_external))
        found = found.select("url", "target", F.when(F.col("kind").isin("page", "script") & inside, "page").when(F.col("kind") == "page", "external link").otherwise(F.col("kind")).alias("kind"), "ord")
    # one pass for both kinds (two branches would parse every page twice): a resource keeps its places
    own = F.when(F.col("kind") != "page", F.col("ord"))
    met = found.groupBy("url", "target", "kind", own.alias("_own")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).cast("int").alias("_n"))
    times = F.when(F.col("kind") == "page", F.lit(1)).otherwise(F.col("_n"))  # rows of one address that is several pages
    return met.select("url", "target", "kind", F.explode(F.array_repeat("ord", times)).alias("ord"))


def srcset_urls(parsed: DataFrame) -> DataFrame:
    """(url, target) of the variants in images' srcset attributes, fragments kept."""
    parts = parsed.where("tag = 'img'").select("url", F.explode(F.split(_attr("srcset"), ",")).alias("p")).select("url", T.strip(F.col("p")).alias("p")).where("p <> ''")
    first = F.get(F.split("p", r"\s+"), F.lit(0))
    base, frag = F.regexp_replace(first, "#.*$", ""), F.regexp_extract(first, "#.*$", 0)
    return parts.select("url", F.concat(urls.resolve(F.col("url"), base), frag).alias("target")).where("target IS NOT NULL")


def paragraphs(parsed: DataFrame, min_words: int = 5) -> DataFrame:
    """(url, ord, paragraph): content paragraphs with at least so many words."""
    return parsed.where("tag = 'p' AND text IS NOT NULL").where(F.size(F.filter(F.split("text", " "), lambda w: w != "")) >= min_words).select("url", "ord", F.col("text").alias("paragraph"))


def console_eggs(parsed: DataFrame) -> DataFrame:
    """(url, ord, message): console messages meant for people, of inline scripts."""
    said = parsed.where("tag = 'script' AND text LIKE '%console%'").select("url", "ord", F.explode(T.console_messages(F.col("text"))).alias("m"))
    return said.select("url", "ord", T.console_message(F.col("m")).alias("message")).where("message IS NOT NULL")


def _once(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first row, by page and place, for each key of a site."""
    least = F.min_by(F.struct(*found.columns), F.struct("found_on", "ord")).alias("r")
    return found.groupBy(*keys).agg(least).select("r.netloc", "r.category", "r.url", "r.detail", "r.found_on")


def mixed_content(parsed: DataFrame) -> DataFrame:
    """Findings: resources and forms of https pages that go over http, each address once a site."""
    which = F.lit(None).cast("string")
    for tag, attr in (*rules.MIXED_CONTENT_TAGS, ("form", "action")):
        which = F.when(F.col("tag") == tag, _attr(attr)).otherwise(which)
    rows = parsed.withColumn("v", which).where("v <> ''").where(urls.scheme(F.col("url")) == "https")
    rows = rows.withColumn("absolute", urls.resolve(F.col("url"), F.col("v"))).where(F.lower("absolute").startswith("http://"))
    detail = F.when(F.col("tag") == "form", "<form> posts over http on an https page").otherwise(F.concat(F.lit("<"), "tag", F.lit("> loaded over http on an https page")))
    return _once(rows.select(urls.site_key(F.col("url")).alias("netloc"), F.lit("mixed_content").alias("category"), F.col("absolute").alias("url"), detail.alias("detail"), F.col("url").alias("found_on"), "ord"), ["netloc", "url"])


def third_party_scripts(parsed: DataFrame) -> DataFrame:
    """Findings: hosts of scripts other than the page's own, each once a site."""
    rows = parsed.where("tag = 'script'").withColumn("absolute", urls.resolve(F.col("url"), _attr("src"))).withColumn("host", urls.site_key(F.col("absolute")))
    rows = rows.where((F.col("host") != "") & (F.col("host") != urls.site_key(F.col("url"))))
    return _once(rows.select(urls.site_key(F.col("url")).alias("netloc"), F.lit("third_party_script").alias("category"), F.col("absolute").alias("url"),
                             F.concat(F.lit("external script host: "), "host").alias("detail"), F.col("url").alias("found_on"), "ord"), ["netloc", "detail"])


def tabnabbing(parsed: DataFrame) -> DataFrame:
    """Findings: links to other hosts in new tabs that keep the opener, each host once a site."""
    rel = F.lower(F.coalesce(_attr("rel"), F.lit("")))
    rows = parsed.where("tag = 'a'").where((F.lower(_attr("target")) == "_blank") & ~rel.contains("noopener") & ~rel.contains("noreferrer"))
    rows = rows.withColumn("absolute", urls.resolve(F.col("url"), _attr("href"))).withColumn("host", urls.site_key(F.col("absolute"))).where((F.col("host") != "") & (F.col("host") != urls.site_key(F.col("url"))))
    found = rows.select(urls.site_key(F.col("url")).alias("netloc"), F.lit("tabnabbing").alias("category"), F.col("absolute").alias("url"),
                        F.lit("target=_blank without rel=noopener (cross-origin)").alias("detail"), F.col("url").alias("found_on"), "ord", "host")
    return _once(found, ["netloc", "host"])
