"""Fetching over HTTP as a Spark data source, and its offline stand-in.

``register(spark)`` adds ``http_pages`` (whole responses), ``http_status`` (HEAD, confirmed by GET)
and ``http_binary``. Addresses come in the option ``urls`` or, one a line, from a file in
``path``; addresses of a host share a partition, so that politeness needs no coordination.
Options: ``delayMin``, ``delayMax``, ``timeout``, ``maxFetchSeconds``, ``maxRetries``, ``proxies``,
``partitions``, and ``maxBytes``, beyond which a response is an error (0, the default: no bound).
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quarrylight import rules

RESPONSE = ("url string, final_url string, status int, redirected boolean, content_type string, headers map<string,string>, "
            "cookies array<struct<name:string,secure:boolean,httponly:boolean,samesite:boolean>>, body string, error string, attempts int")
STATUS = "url string, final_url string, status int, redirected boolean, error string, attempts int"
BINARY = "url string, final_url string, status int, content_type string, body binary, error string"


class _Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.value = urls


def by_host(urls: list[str], most: int) -> list[list[str]]:
    """Addresses in at most ``most`` groups, those of a host together."""
    hosts: dict[str, list[str]] = {}
    for u in urls:
        hosts.setdefault(u.split("/")[2].lower() if u.count("/") > 1 else u, []).append(u)
    groups: list[list[str]] = [[] for _ in range(max(1, min(most, len(hosts))))]
    for own in sorted(hosts.values(), key=len, reverse=True):
        min(groups, key=len).extend(own)
    return [g for g in groups if g]


def cookie_row(line: str) -> tuple:
    name = line.split("=", 1)[0].strip()
    flags = {p.split("=", 1)[0].strip().lower() for p in line.split(";")[1:]}
    return name, "secure" in flags, "httponly" in flags, "samesite" in flags


class Fetcher:
    """One task's fetching: pauses, retries, cooldowns, a deadline for each response."""

    def __init__(self, options: dict):
        get = lambda k, d: float(options.get(k, d))
        self.pause = get("delayMin", 0.4), get("delayMax", 1.2)
        self.timeout, self.deadline = get("timeout", 15), get("maxFetchSeconds", 30)
        self.retries, self.most = int(get("maxRetries", 2)), int(get("maxBytes", 0))
        self.proxies = [p.strip() for p in options.get("proxies", "").split(",") if p.strip() and not p.strip().startswith("#")]
        self.sleep: Callable[[float], None] = time.sleep
        self.streak: dict[str, int] = {}

    def opened(self, url: str, method: str):
        request = urllib.request.Request(url, method=method, headers={"User-Agent": random.choice(rules.USER_AGENTS)})
        handlers = []
        if self.proxies:
            proxy = random.choice(self.proxies)
            handlers.append(urllib.request.ProxyHandler({"http": proxy, "https": proxy}))
        try:
            return urllib.request.build_opener(*handlers).open(request, timeout=self.timeout)
        except urllib.error.HTTPError as answer:
            return answer

    def body(self, answer) -> bytes:
        begun, parts, size = time.monotonic(), [], 0
        while chunk := answer.read(8192):
            parts.append(chunk)
            size += len(chunk)
            if time.monotonic() - begun > self.deadline:
                raise TimeoutError(f"exceeded {self.deadline:.0f}s wall-clock fetch limit")
            if 0 < self.most < size:
                raise ValueError(f"more than {self.most} bytes")
        return b"".join(parts)

    def get(self, url: str, method: str = "GET", read: bool = True):
        """(answer, body, error, attempts): an error is a value, not an exception."""
        host = url.split("/")[2].lower() if url.count("/") > 1 else ""
        for attempt in range(self.retries + 1):
            self.sleep(random.uniform(*self.pause))
            try:
                answer = self.opened(url, method)
                data = self.body(answer) if read else b""
            except (ConnectionError, TimeoutError, urllib.error.URLError) as why:
                if attempt < self.retries and not isinstance(why, TimeoutError):
                    self.sleep(min(2 ** attempt, 8))
                    continue
                return None, b"", str(why), attempt + 1
            except Exception as why:
                return None, b"", str(why), attempt + 1
            if answer.status in rules.RATE_LIMIT_CODES and attempt < self.retries:
                self.streak[host] = self.streak.get(host, 0) + 1
                self.sleep(cooldown(self.streak[host], answer.headers.get("Retry-After")))
                continue
            self.streak.pop(host, None)
            return answer, data, None, attempt + 1
        return None, b"", "no answer", self.retries + 1


def cooldown(streak: int, retry_after: str | None) -> float:
    """Seconds to leave a host alone: doubling from 2, at least what it asks for, 60 at most."""
    try:
        asked = max(0.0, float((retry_after or "").strip()))
    except ValueError:
        asked = 0.0
    return min(max(2.0 * 2 ** (streak - 1), asked), 60.0)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _urls(self) -> list[str]:
        if "urls" in self.options:
            return [u.strip() for u in self.options["urls"].split("\n") if u.strip()]
        with open(self.options["path"], encoding="utf-8") as f:
            return [u.strip() for u in f if u.strip() and not u.startswith("#")]

    def partitions(self) -> list[InputPartition]:
        return [_Hosts(g) for g in by_host(self._urls(), int(self.options.get("partitions", 64)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetcher = Fetcher(self.options)
        for url in partition.value:
            yield self.row(fetcher, url)

    def row(self, fetcher: Fetcher, url: str) -> tuple:
        raise NotImplementedError


class _PageReader(_Reader):
    def row(self, fetcher: Fetcher, url: str) -> tuple:
        answer, body, error, attempts = fetcher.get(url)
        if answer is None:
            return url, None, None, False, None, None, None, None, error, attempts
        encoding = answer.headers.get_content_charset() or "utf-8"
        try:
            text = body.decode(encoding, "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        return (url, answer.url, answer.status, answer.url != url, answer.headers.get("Content-Type", ""), dict(answer.headers.items()),
                [cookie_row(c) for c in answer.headers.get_all("Set-Cookie") or []], text, None, attempts)


class _StatusReader(_Reader):
    def row(self, fetcher: Fetcher, url: str) -> tuple:
        answer, _, error, attempts = fetcher.get(url, "HEAD", False)
        if answer is not None and answer.status >= 400 and answer.status not in rules.RATE_LIMIT_CODES:
            answer, _, error, more = fetcher.get(url, "GET", False)
            attempts += more
        if answer is None:
            return url, None, None, False, error, attempts
        return url, answer.url, answer.status, answer.url != url, None, attempts


class _BinaryReader(_Reader):
    def row(self, fetcher: Fetcher, url: str) -> tuple:
        answer, body, error, _ = fetcher.get(url)
        if answer is None:
            return url, None, None, None, None, error
        return url, answer.url, answer.status, answer.headers.get("Content-Type", ""), body, None


def _source(label: str, ddl: str, reader: type) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader(self.options)

    return Source


HttpPages, HttpStatus, HttpBinary = _source("http_pages", RESPONSE, _PageReader), _source("http_status", STATUS, _StatusReader), _source("http_binary", BINARY, _BinaryReader)


def register(spark: SparkSession) -> None:
    for source in (HttpPages, HttpStatus, HttpBinary):
        spark.dataSource.register(source)


def fetch_wave(options: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    """A crawl's ``fetch``: each wave's rows go to tasks by host, and each task fetches its own."""
    settings = dict(options or {})

    def fetch(wave: DataFrame) -> DataFrame:
        def run(frames):
            import pandas as pd

            reader = _PageReader(settings)
            fetcher = Fetcher(settings)
            for f in frames:
                yield pd.DataFrame([reader.row(fetcher, u) for u in f["url"]], columns=[c.split()[0] for c in RESPONSE.split(", ")])

        return wave.select("url").repartition(F.regexp_extract("url", "//([^/]*)", 1)).mapInPandas(run, RESPONSE)

    return fetch


def check_wave(options: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    """A crawl's ``check``: the status of each address, by host, as ``http_status`` finds it."""
    settings = dict(options or {})

    def check(wave: DataFrame) -> DataFrame:
        def run(frames):
            import pandas as pd

            reader, fetcher = _StatusReader(settings), Fetcher(settings)
            for f in frames:
                yield pd.DataFrame([reader.row(fetcher, u) for u in f["url"]], columns=[c.split()[0] for c in STATUS.split(", ")])

        return wave.select("url").distinct().repartition(F.regexp_extract("url", "//([^/]*)", 1)).mapInPandas(run, STATUS)

    return check


def binary_wave(options: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    """The bytes of each address, by host, as ``http_binary`` has them."""
    settings = dict(options or {})

    def fetch(wave: DataFrame) -> DataFrame:
        def run(frames):
            import pandas as pd

            reader, fetcher = _BinaryReader(settings), Fetcher(settings)
            for f in frames:
                yield pd.DataFrame([reader.row(fetcher, u) for u in f["url"]], columns=[c.split()[0] for c in BINARY.split(", ")])

        return wave.select("url").distinct().repartition(F.regexp_extract("url", "//([^/]*)", 1)).mapInPandas(run, BINARY)

    return fetch


def recorded(pages: DataFrame, schema: str = RESPONSE) -> Callable[[DataFrame], DataFrame]:
    """A crawl's ``fetch`` (or, with the schema ``STATUS``, its ``check``) from a table of recorded responses; an address that isn't there answers 404."""
    have = {c: t for c, t in pages.dtypes}

    def fetch(wave: DataFrame) -> DataFrame:
        out = wave.select("url").distinct().join(pages.withColumn("_there", F.lit(True)), "url", "left")
        missing = F.col("_there").isNull()
        cols = []
        for name, kind in _columns(schema):
            c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
            if name == "status":
                c = F.when(missing, F.lit(404)).otherwise(F.coalesce(c, F.lit(200)))
            elif name == "final_url":
                c = F.coalesce(c, F.col("url"))
            elif name == "redirected":
                c = F.coalesce(c, F.lit(False))
            elif name == "content_type":
                c = F.coalesce(c, F.lit("text/html"))
            elif name == "attempts":
                c = F.coalesce(c, F.lit(1))
            cols.append(c.alias(name))
        return out.select(*cols)

    return fetch


def _columns(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]
