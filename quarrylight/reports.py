"""Reports: rows with severities, text sections, a self-contained HTML table and a gallery.

Rows and their order are made by Spark; the driver only streams what it prints.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import text as T
from quarrylight.operators import relational as R

#: Stored category, title of its section, and its line (fixed values of the report's contract).
SECTIONS = (
    ("broken", "BROKEN LINKS (404/410/other errors)", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("broken_resource", "BROKEN RESOURCES (images/css/iframes/scripts/external links)", "[{detail}] ({kind}) {url}\n    found on: {found_on}\n"),
    ("unverified_resource", "UNVERIFIED RESOURCES (bot-blocking hosts / cross-origin 401-403 - likely fine, not broken)", "[{detail}] ({kind}) {url}\n    found on: {found_on}\n"),
    ("security_code", "SECURITY-WATCH STATUS CODES (401/403/5xx)", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("exposed_path", "EXPOSED PATHS (probed - .git/.env/backups/etc.)", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("rate_limited", "RATE-LIMITED / COULD NOT VERIFY (429/503 after retries)", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("directory_listing", "DIRECTORY LISTINGS EXPOSED", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("mixed_content", "MIXED CONTENT (http resources on an https page)", "{url}\n    {detail}\n    found on: {found_on}\n"),
    ("cookie_flag", "COOKIES MISSING SECURITY FLAGS", "{detail}\n    seen on: {found_on}\n"),
    ("missing_header", "MISSING SECURITY HEADERS (checked once, against {checked})", "{detail}\n"),
    ("legacy_file", "LEGACY/INACCESSIBLE FILE TYPES (pdf/doc/ppt/xls)", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("sensitive_file", "SENSITIVE/DATA-EXPOSURE FILE TYPES", "[{detail}] {url}\n    found on: {found_on}\n"),
    ("risky_param", "URLS WITH SUSPICIOUS PARAMETER VALUES (redirect/SSRF/traversal/debug)", "{url}\n    {detail}\n    found on: {found_on}\n"),
    ("secret", "POSSIBLE LEAKED API KEYS / CREDENTIALS", "[{kind}] {detail}\n    found on: {url}\n"),
    ("secret_info", "PUBLIC / LOW-CONFIDENCE KEYS (informational - meant to be public)", "[{kind}] {detail}\n    found on: {url}\n"),
    ("version_disclosure", "VERSION-DISCLOSURE HEADERS (informational)", "{detail}\n    on: {url}\n"),
    ("third_party_script", "THIRD-PARTY SCRIPT HOSTS (informational - supply-chain surface)", "{detail}\n    e.g. {url}\n    seen on: {found_on}\n"),
    ("tabnabbing", "target=_blank WITHOUT rel=noopener (informational - tabnabbing)", "{url}\n    found on: {found_on}\n"),
)
RULE = "=" * 70


def report_rows(findings: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(netloc, position, category, severity, detail, url, found_on) of distinct findings and missing headers, NULLs as empty text."""
    names = F.create_map(*(F.lit(x) for k, v in rules.FINDING_CATEGORIES for x in (k, v)))
    places = F.create_map(*(F.lit(x) for i, (k, _) in enumerate(rules.FINDING_CATEGORIES) for x in (k, i if i < 9 else i + 1)))
    rows = R.distinct_findings(findings).where("netloc IS NOT NULL")
    display, kind = names[F.col("category")], F.coalesce("kind", F.lit(""))
    shown = F.when(F.col("category").isin("broken_resource", "unverified_resource"), F.concat(display, F.lit(" ("), kind, F.lit(")"))).otherwise(F.coalesce(display, "category"))
    detail = F.when(F.col("category").isin("secret", "secret_info"), F.concat(kind, F.lit(": "), F.coalesce("detail", F.lit("")))).otherwise(F.coalesce("detail", F.lit("")))
    out = rows.select("netloc", F.coalesce(places[F.col("category")], F.lit(99)).alias("position"), shown.alias("category"), detail.alias("detail"), F.coalesce("url", F.lit("")).alias("url"),
                      F.when(F.col("category").isin("secret", "secret_info", "scan_caveat"), "").otherwise(F.coalesce("found_on", F.lit(""))).alias("found_on"))
    if stats is not None:
        out = out.unionByName(missing_headers(stats).select("netloc", F.lit(9).alias("position"), F.lit("Missing Security Header").alias("category"), F.col("header").alias("detail"),
                                                            F.coalesce("header_checked_url", F.lit("")).alias("url"), F.lit("").alias("found_on")))
    return out.select("netloc", "position", "category", T.severity(F.col("category")).alias("severity"), "detail", "url", "found_on")


def missing_headers(stats: DataFrame) -> DataFrame:
    """(netloc, header_checked_url, header) from the JSON lists of the statistics; empty and cut-off lists give nothing."""
    names = F.from_json("missing_headers", "array<string>", {"mode": "PERMISSIVE"})
    return stats.select("netloc", "header_checked_url", F.explode(names).alias("header")).where("header IS NOT NULL")


def text_report(findings: DataFrame, stats: DataFrame, netloc: str, now: datetime, seconds: float = 0.0, partial: bool = False) -> Iterator[str]:
    """Lines of a site's text report, streamed section by section."""
    own = stats.where(F.col("netloc") == netloc).limit(1).collect()
    n = {c: (own[0][c] or 0) if own else 0 for c in ("pages_crawled", "robots_blocked", "pattern_skipped", "query_skipped")}
    checked = own[0]["header_checked_url"] if own else None
    yield f"Deep Dive Audit Report - {netloc}\n"
    if partial:
        yield "*** PARTIAL / IN-PROGRESS CHECKPOINT - crawl was still running when this was written ***\n"
    yield f"Generated: {now.isoformat(timespec='seconds')}\nPages crawled: {n['pages_crawled']}\nRobots.txt blocked: {n['robots_blocked']}\n"
    yield f"Skipped by path-prefix limit: {n['pattern_skipped']}\nSkipped by query-variant limit: {n['query_skipped']}\nDuration: {seconds:.1f}s\n{RULE}\n\n"
    site = findings.where(F.col("netloc") == netloc)
    caveats = R.findings_of(site, netloc, "scan_caveat")
    lines = [f"{r.url.split('/')[2] if r.url and r.url.count('/') > 1 else r.url}: {r.detail}\n" for r in caveats.toLocalIterator()]
    if lines:
        yield "SCAN CAVEATS (host behaviour that affects broken-link accuracy)\n" + "-" * 70 + "\n" + "".join(lines) + "\n"
    for category, title, shape in SECTIONS:
        if category == "missing_header":
            names = [r.header for r in missing_headers(stats.where(F.col("netloc") == netloc)).collect()]  # five at most
            yield title.format(checked=checked or "n/a") + "\n" + "-" * 70 + "\n"
            yield "".join(f"{h}\n" for h in names) or ("None missing.\n" if checked else "Not checked (no successful page load).\n")
            yield "\n"
            continue
        rows = R.findings_of(site, netloc, category)
        count = rows.count()
        yield f"{title} ({count})\n" + "-" * 70 + "\n"
        for r in rows.toLocalIterator():
            yield shape.format(**{k: "" if v is None else v for k, v in r.asDict().items()})
        yield ("" if count else "None found.\n") + "\n"


def quick_report(start: str, checked: DataFrame, now: datetime, pages: int, seconds: float = 0.0) -> Iterator[str]:
    """Lines of the one-site report of ``checked`` (url, status_text, found_on, kind, broken, flagged, hostile)."""
    yield f"Quick Scan Report - {start}\nGenerated: {now.isoformat(timespec='seconds')}\nPages crawled: {pages}\nLinks/resources checked: {checked.where('NOT hostile').count()}\n"
    hosts = checked.where("hostile").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("host")), ", ").alias("h")).first()
    if hosts.n:
        yield f"Skipped (bot-blocking hosts, not checked): {hosts.n} link(s) to {hosts.h}\n"
    yield f"Duration: {seconds:.1f}s\n{RULE}\n\n"
    for title, which in (("BROKEN LINKS / RESOURCES / ERROR RESPONSES", "broken"), ("FLAGGED FILE TYPES - .pdf/.txt/.doc/.docx", "flagged")):
        rows = checked.where(which).orderBy("url", "found_on")
        n = rows.count()
        yield f"{title} ({n})\n" + "-" * 70 + "\n"
        for r in rows.toLocalIterator():
            yield f"[{r.status_text}] ({r.kind}) {r.url}\n    found on: {r.found_on}\n"
        yield ("" if n else "None found.\n") + "\n"


def embedded_json(payload: dict) -> str:
    """JSON that can't end the script element it stands in."""
    return json.dumps(payload).replace("</", "<\\/")


_HEAD = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif}}td,th{{padding:4px 8px;text-align:left}}.critical{{color:#b00}}.warning{{color:#a60}}.chip{{margin:2px;padding:2px 8px}}.on{{font-weight:bold}}</style></head>
<body><h1>{title}</h1><p>{lines}</p><p id="chips"></p><input id="q" placeholder="search"> <button id="copy">copy visible rows</button> <span id="n"></span>
<table><thead><tr><th>category</th><th>detail</th><th>url</th><th>found_on</th></tr></thead><tbody id="b"></tbody></table>
<script type="application/json" id="d">"""
_TAIL = """</script>
<script>const rows=JSON.parse(document.getElementById("d").textContent).rows,at=i=>document.getElementById(i),cells=["category","detail","url","found_on"],chosen=new Set();let key="",dir=1;
const num=v=>v.trim()!==""&&!isNaN(v);
const visible=()=>{const s=at("q").value.trim().toLowerCase();const kept=rows.filter(r=>(!chosen.size||chosen.has(r.category))&&(!s||cells.map(c=>r[c]).join(" ").toLowerCase().includes(s)));
return key?kept.sort((x,y)=>dir*(num(x[key])&&num(y[key])?x[key]-y[key]:num(x[key])?-1:num(y[key])?1:x[key].toLowerCase().localeCompare(y[key].toLowerCase()))):kept};
const draw=()=>{const shown=visible();at("b").textContent="";at("n").textContent=shown.length+" of "+rows.length;shown.forEach(r=>{const t=document.createElement("tr");t.className=r.severity;cells.forEach(k=>{const c=document.createElement("td");c.textContent=r[k];t.append(c)});at("b").append(t)})};
const counts=new Map();rows.forEach(r=>counts.set(r.category,(counts.get(r.category)||0)+1));
[...counts].sort((x,y)=>y[1]-x[1]).forEach(([c,n])=>{const b=document.createElement("button");b.className="chip";b.textContent=c+" ("+n+")";b.onclick=()=>{chosen.has(c)?chosen.delete(c):chosen.add(c);b.classList.toggle("on");draw()};at("chips").append(b)});
at("copy").onclick=()=>navigator.clipboard.writeText([cells.join("\\t"),...visible().map(r=>cells.map(k=>r[k].replace(/[\\t\\n]/g," ")).join("\\t"))].join("\\n"));
at("q").oninput=draw;document.querySelectorAll("th").forEach(h=>h.onclick=()=>{dir=key===h.textContent?-dir:1;key=h.textContent;draw()});draw();</script></body></html>"""


def html_parts(rows: DataFrame, meta: dict, order: list[str] | None = None) -> Iterator[str]:
    """One self-contained page with the report rows of a site, row by row: chips of categories with their counts to choose several by, search, sorting, and copying of what is visible.

    Rows are rendered where they lie and streamed; neither the rows nor the page are held whole.
    """
    ordered = rows.orderBy(*(order or ["position", "url", "detail"])).select("category", "severity", "detail", "url", "found_on")
    lines = "<br>".join(html.escape(str(x), quote=False) for x in meta.get("lines", ()))
    yield _HEAD.format(title=html.escape(meta.get("title", "report"), quote=False), lines=lines)
    yield '{"meta": ' + embedded_json(meta) + ', "rows": ['
    made = F.replace(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ordered.columns))), F.lit("</"), F.lit("<\\/"))
    for k, r in enumerate(ordered.select(made.alias("j")).toLocalIterator()):
        yield (",\n" if k else "") + r.j
    yield "]}" + _TAIL


def html_report(rows: DataFrame, meta: dict, order: list[str] | None = None) -> str:
    """The page of ``html_parts`` as one text, for reports that are small."""
    return "".join(html_parts(rows, meta, order))


# --- gallery ------------------------------------------------------------------------------------
def card(kind: Column, text: Column, url: Column, domain: Column, score: Column, tags: Column) -> Column:
    """HTML of a find, made where the find lies."""
    label = F.lit(None).cast("string")
    for k, v in rules.KIND_LABELS.items():
        label = F.when(kind == k, F.lit(v)).otherwise(label)
    tag = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit('<span class="tag">'), T.escape(t), F.lit("</span>"))), "")
    text_of = lambda c: T.escape(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(F.lit('<div class="card"><div class="meta"><span class="kind">'), text_of(F.coalesce(label, kind)), F.lit("</span>"), tag, F.lit('<span class="score">score '), text_of(score),
                    F.lit("</span></div><pre>"), text_of(text), F.lit('</pre><div class="src"><a href="'), text_of(url), F.lit('" rel="noopener noreferrer nofollow">'), text_of(domain), F.lit("</a></div></div>"))


def gallery(finds: DataFrame, now: datetime) -> str:
    """The gallery page: best, latest and last of each kind; sections have at most 40, 80 and 120 finds."""
    made = card(*(F.col(c) for c in ("kind", "text", "url", "domain", "score", "tags")))
    shown = lambda df: [r.card for r in df.select(made.alias("card")).collect()]  # noqa: E731  bounded by the limits above
    best, latest = shown(R.hall_of_fame(finds)), shown(R.most_recent(finds))
    parts = [f'<h2>Hall of Fame <span class="n">top {len(best)}</span></h2>', "".join(best) or '<p class="empty">nothing yet</p>', f'<h2>Most recent <span class="n">last {len(latest)}</span></h2>', "".join(latest)]
    counts = {r.kind: r.n for r in finds.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    for kind, label in rules.KIND_LABELS.items():
        if kind in counts:
            last = R.most_recent(finds.where(F.col("kind") == kind), 120)
            parts += [f'<h2>{html.escape(label)} <span class="n">{counts[kind]}</span></h2>', "".join(shown(last))]
    summary = " · ".join(f"{n} {rules.KIND_LABELS.get(k, k)}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    domains = finds.agg(F.count_distinct("domain")).first()[0]
    return f'<!doctype html><meta charset="utf-8"><title>Gallery</title><h1>{sum(counts.values())} finds on {domains} domains</h1><p>{html.escape(summary)}</p><p>{now.isoformat(timespec="seconds")}</p>' + "".join(parts)
