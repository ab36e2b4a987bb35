"""The six tools as commands: quick scan, deep audit, e-mail audit, image scrape, corpus, hunt.

Each is a crawl and the plans that follow it; what it keeps lies below ``--output-dir``: the state
of the crawl, from which an interrupted run goes on, and the tool's reports. ``--pages`` takes
recorded responses (a Parquet table with ``url`` and ``body``) in place of the network.
"""

from __future__ import annotations

import argparse
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import reports
from quarrylight.functions import urls
from quarrylight.operators import relational as R
from quarrylight.operators.frontier import Crawl, Limits
from quarrylight.plans import pipelines
from quarrylight.sources import files, http
from quarrylight.storage import cut


def parser() -> argparse.ArgumentParser:
    """Tools, their options and defaults."""
    top = argparse.ArgumentParser(prog="quarrylight", description="Audit and mine web sites.")
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, what: str, inputs: str = "inputs", output: str = ".", delays: tuple[float, float] = (0.4, 1.2), timeout: float = 10) -> argparse.ArgumentParser:
        p = tools.add_parser(name, help=what, description=what)
        p.add_argument(inputs, nargs=None if inputs == "url" else "+", help="addresses, or one file with an address a line" if inputs == "inputs" else "where to begin")
        p.add_argument("--delay-min", type=float, default=delays[0], help="least seconds between requests to a host")
        p.add_argument("--delay-max", type=float, default=delays[1], help="most seconds between requests to a host")
        p.add_argument("--timeout", type=float, default=timeout, help="seconds to connect and for each read")
        p.add_argument("--max-fetch-seconds", type=float, default=30, help="seconds a response may take in all")
        p.add_argument("--output-dir", default=output, help="folder of reports and state")
        p.add_argument("--fresh", action="store_true", help="forget what earlier runs left")
        p.add_argument("--pages", help="Parquet table of recorded responses instead of the network")
        return p

    quick = tool("quick", "Broken links and flagged files of one site.", "url", timeout=15)
    quick.add_argument("--max-pages", type=int, default=0, help="pages to fetch (0: all)")

    audit = tool("audit", "Thorough audit of several sites.", "urls", "reports", (0.1, 0.6), 15)
    for name, kind, default, what in (("--threads", int, 8, "hosts fetched at a time"), ("--max-retries", int, 2, "further tries after a rate limit or momentary failure"), ("--max-pages", int, 5000, "addresses to discover (0: all)"),
                                      ("--proxy", str, None, "one proxy"), ("--proxy-file", str, None, "file with a proxy a line"), ("--checkpoint-interval", float, 120, "seconds between partial reports (0: none)"),
                                      ("--max-per-path-prefix", int, 0, "pages below a path prefix (0: all)"), ("--path-prefix-depth", int, 1, "segments of a prefix"), ("--max-depth", int, 0, "links from a seed (0: any)"),
                                      ("--max-query-variants", int, 0, "queries of a path (0: all)"), ("--state-db", str, None, "folder of the crawl's state")):
        audit.add_argument(name, type=kind, default=default, help=what)
    for name, what in (("--no-soft-404", "don't look for not-found pages in disguise"), ("--ignore-robots", "fetch what robots.txt disallows"), ("--allow-external", "follow links to other sites"), ("--probe-common-paths", "ask for paths that should not be public")):
        audit.add_argument(name, action="store_true", help=what)

    emails = tool("emails", "E-mail addresses on a list of sites.")
    emails.add_argument("--max-pages", type=int, default=150, help="pages a site (0: all)")

    images = tool("images", "Images of a list of sites.")
    for name, default, what in (("--max-pages", 150, "pages a site (0: all)"), ("--max-images", 300, "images a site (0: all)"), ("--min-width", 100, "least width (0: any)"), ("--min-height", 100, "least height (0: any)")):
        images.add_argument(name, type=int, default=default, help=what)
    images.add_argument("--allow-external", action="store_true", help="follow links to other sites")

    corpus = tool("corpus", "Paragraphs of the open web.")
    hunt = tool("hunt", "Comments and other things written for people to find.")
    for p, per_host in ((corpus, 25), (hunt, 5)):
        p.add_argument("--max-pages", type=int, default=500, help="pages to fetch (0: all)")
        p.add_argument("--max-pages-per-domain", type=int, default=per_host, help="pages a host (0: all)")
        p.add_argument("--ignore-robots", action="store_true", help="fetch what robots.txt disallows")
    corpus.add_argument("--min-words", type=int, default=5, help="least words of a paragraph")
    hunt.add_argument("--max-finds-per-domain", type=int, default=25, help="finds a host (0: all)")
    hunt.add_argument("--gallery-every", type=int, default=25, help="pages between two galleries")
    hunt.add_argument("--no-humans-txt", action="store_true", help="don't ask for humans.txt")
    return top


class _Run:
    """What the tools share: session, sources of responses, folder of the output."""

    def __init__(self, args: argparse.Namespace, spark: SparkSession):
        self.args, self.spark, self.begun = args, spark, time.time()
        self.out = Path(args.output_dir).absolute()
        self.out.mkdir(parents=True, exist_ok=True)
        self.options = {"delayMin": args.delay_min, "delayMax": args.delay_max, "timeout": args.timeout, "maxFetchSeconds": args.max_fetch_seconds}
        if getattr(args, "max_retries", None) is not None:
            self.options["maxRetries"] = args.max_retries
        proxies = [args.proxy] if getattr(args, "proxy", None) else []
        if getattr(args, "proxy_file", None):
            proxies += Path(args.proxy_file).read_text(encoding="utf-8").split()
        if proxies:
            self.options["proxies"] = ",".join(proxies)
        self.options = {k: str(v) for k, v in self.options.items()}
        self.pages = spark.read.parquet(args.pages) if args.pages else None
        self.fetch = http.recorded(self.pages) if args.pages else http.fetch_wave(self.options)

    def at(self, name: str) -> str:
        return f"file://{self.out}/{name}"

    def seeds(self) -> list[str]:
        return files.seeds(self.spark, getattr(self.args, "inputs", None) or getattr(self.args, "urls", None) or [self.args.url])

    def crawl(self, seeds: list[str], limits: Limits, state: str, **more) -> Crawl:
        return pipelines.crawl(self.spark, seeds, self.pages, limits, state if "://" in state else self.at(state), options=self.options, fresh=self.args.fresh, **more)

    def say(self, **figures) -> dict:
        figures = {"elapsed": round(time.time() - self.begun, 1), **figures}
        for k, v in figures.items():
            print(f"{k.replace('_', ' ')}: {v}")
        return figures


def _written(path: Path, parts) -> str:
    with path.open("w", encoding="utf-8") as f:
        f.writelines(parts)
    return str(path)


def quick(run: _Run) -> dict:
    start = run.spark.createDataFrame([(run.args.url,)], "u string").select(urls.with_scheme(F.col("u"))).first()[0]
    c = run.crawl([start], Limits(max_pages=run.args.max_pages), ".crawl_state/quick", check=True)
    answers = c.responses().select("url", "status", "error").unionByName(c.checks().select("url", "status", "error"))
    checked = cut(pipelines.quick_scan(answers, c.frontier().where("depth > 0").select(F.col("source").alias("url"), F.col("url").alias("target"), "kind")), "quick")
    pages, now, took = c.responses().count(), datetime.now(), time.time() - run.begun
    text = _written(run.out / "quick_scan_report.txt", reports.quick_report(start, checked, now, pages, took))
    rows = checked.where("broken OR flagged").select(F.when(F.col("broken"), "Broken").otherwise("Flagged File").alias("category"), F.when(F.col("broken"), "critical").otherwise("warning").alias("severity"), F.col("status_text").alias("detail"), "url", "found_on")
    page = _written(run.out / "quick_scan_report.html", reports.html_parts(rows, {"title": f"Quick Scan Report - {start}"}, ["category", "url"]))
    return run.say(pages_crawled=pages, checked=checked.where("NOT hostile").count(), broken=checked.where("broken").count(), flagged=checked.where("flagged").count(), report=text, sortable_report=page)


def audit(run: _Run) -> dict:
    a = run.args
    seeds = run.seeds()
    limits = Limits(max_rows=a.max_pages, max_depth=a.max_depth, max_per_prefix=a.max_per_path_prefix, prefix_depth=a.path_prefix_depth, max_query_variants=a.max_query_variants, allow_external=a.allow_external, count_occurrences=True)
    made: dict = {}

    def report(c: Crawl, partial: bool) -> None:
        found, stats = pipelines.audit_tables(c, run.fetch, not a.no_soft_404)
        found, stats = cut(found, "findings"), cut(stats, "stats")
        seconds, now = time.time() - run.begun, datetime.now()
        made["sites"] = [r.netloc for r in R.sites_with_data(stats, found).toLocalIterator()]  # a report each
        for site in made["sites"]:
            stem = site.replace(":", "_") or "site"
            _written(run.out / f"{stem}.txt", reports.text_report(found, stats, site, now, seconds, partial))
            own = reports.report_rows(found.where(F.col("netloc") == site), stats.where(F.col("netloc") == site))
            _written(run.out / f"{stem}.html", reports.html_parts(own, {"title": f"Deep Dive Audit Report - {site}", "partial": partial}))
        made["findings"] = found.count()

    c = pipelines.audit_crawl(run.spark, seeds, run.pages, limits, f"file://{Path(a.state_db).absolute()}" if a.state_db else run.at(".crawl_state/audit"), run.options, a.fresh, None if a.ignore_robots else "standard", a.probe_common_paths)
    last = time.time()
    while c.step():
        if a.checkpoint_interval and time.time() - last >= a.checkpoint_interval and c.responses() is not None:
            report(c, True)
            last = time.time()
    report(c, False)
    return run.say(pages_crawled=c.responses().count(), reports=len(made["sites"]), findings=made["findings"])


def _todo(run: _Run) -> list[str]:
    """Seeds that no earlier, interrupted run has finished."""
    if run.args.fresh:
        files.save_completed(run.spark, run.at(".completed.json"), [])
    done = set(files.completed(run.spark, run.at(".completed.json")))
    return [s for s in run.seeds() if s not in done]


def _per_site(run: _Run) -> Crawl:
    """One crawl of all sites that are left; each has its own cap of pages."""
    a = run.args
    return run.crawl(_todo(run), Limits(max_per_host=a.max_pages, allow_external=getattr(a, "allow_external", False)), ".crawl_state/sites")


def emails(run: _Run) -> dict:
    c = _per_site(run)
    answers = c.responses().join(c.frontier().select("url", "wave", "seq"), "url").withColumn("place", F.struct("wave", "seq"))
    found = cut(pipelines.email_audit(answers, "place"), "emails")
    blocks = pipelines.email_report(found).select("block")
    with (run.out / "email_audit_report.txt").open("a", encoding="utf-8") as f:
        for r in blocks.toLocalIterator():
            f.write(r.block + "\n\n")
    new = files.append_new_lines(found, "email", run.at("emails"))
    files.save_completed(run.spark, run.at(".completed.json"), [])  # the list is done: a later run is a fresh one
    return run.say(pages_crawled=c.responses().count(), unique_emails=found.select("email").distinct().count(), new_emails=new, report=str(run.out / "email_audit_report.txt"))


def images(run: _Run) -> dict:
    a, folder = run.args, run.out / "images"
    c = _per_site(run)
    binary = http.recorded(run.pages, http.BINARY) if run.pages is not None else http.binary_wave(run.options)
    links = pipelines.image_links(c.responses())
    answers = cut(binary(links.select(F.col("image_url").alias("url"))).join(links.withColumnRenamed("image_url", "url"), "url"), "images")
    made = cut(pipelines.image_scrape(answers, a.min_width, a.min_height, files.image_hashes(run.spark, f"file://{folder}").select("sha256"), a.max_images), "image-rows")
    manifest = files.save_images(made.where("NOT duplicate"), str(folder))
    lines = made.join(manifest.select("image_url", "saved_path"), "image_url", "left").orderBy("site", "image_url").select("image_url", "found_on", "duplicate", "saved_path")
    with (run.out / "manifest.txt").open("a", encoding="utf-8") as f:
        f.write(f"--- run started at {datetime.fromtimestamp(run.begun).isoformat(timespec='seconds')} ---\n")
        for r in lines.toLocalIterator():
            f.write(f"    {r.image_url}\n        found on: {r.found_on}\n        {'(duplicate content, not re-saved)' if r.duplicate else 'saved: ' + r.saved_path}\n")
    whole = pipelines.image_totals(made).agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("s"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("d")).first()
    files.save_completed(run.spark, run.at(".completed.json"), [])
    return run.say(pages_crawled=c.responses().count(), images_downloaded=whole.s, duplicates_skipped=whole.d, manifest=str(run.out / "manifest.txt"))


def _roam(run: _Run, home_first: bool) -> Crawl:
    a = run.args
    return pipelines.crawl(run.spark, run.seeds(), run.pages, pipelines.roaming(a.max_pages, a.max_pages_per_domain, home_first), run.at(".crawl_state/roam"), options=run.options, fresh=a.fresh, robots_txt=None if a.ignore_robots else "wildcard", roam=True, begin_only=True)


def corpus(run: _Run) -> dict:
    c = _roam(run, False).run()
    paragraphs = cut(pipelines.corpus(c.responses(), run.args.min_words), "corpus")
    new = files.append_new_lines(paragraphs, "paragraph", run.at("corpus"))
    files.save_frontier(c.pending(), run.at("frontier"), ["wave", "priority", "depth", "seq"])
    return run.say(pages_fetched=c.responses().count(), paragraphs=paragraphs.count(), new_paragraphs=new, waiting=c.pending().count())


def hunt(run: _Run) -> dict:
    a, c = run.args, _roam(run, True)
    if a.fresh and files.exists(run.spark, run.at("finds")):
        fs, at = files._fs(run.spark, run.at("finds"))
        fs.delete(at, True)

    def keep() -> DataFrame:
        found = pipelines.hunt(c.responses(), datetime.now().isoformat(timespec="seconds"), a.max_finds_per_domain, None if a.no_humans_txt else run.fetch)
        files.add_finds(cut(found, "finds"), run.at("finds"), a.max_finds_per_domain)
        whole = files.finds(run.spark, run.at("finds"))
        _written(run.out / "gallery.html", [reports.gallery(whole, datetime.now())])
        return whole

    seen = 0
    while c.step():
        pages = c.responses().count()
        if pages - seen >= a.gallery_every:
            keep()
            seen = pages
    whole = keep()
    return run.say(pages_fetched=c.responses().count(), finds=whole.count(), waiting=c.pending().count(), gallery=str(run.out / "gallery.html"))


TOOLS = {"quick": quick, "audit": audit, "emails": emails, "images": images, "corpus": corpus, "hunt": hunt}


def main(argv: list[str], spark: SparkSession | None = None) -> dict:
    """Runs a tool; returns the figures it prints."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"quarrylight {args.tool}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return TOOLS[args.tool](_Run(args, spark))
