"""URL algebra as column expressions: nothing here leaves the JVM but ``resolve``.

A URL is taken apart with the generic-syntax pattern of RFC 3986, appendix B, because
``parse_url`` raises on, or returns NULL for, many addresses that occur in crawls.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.match import contains_any, ends_with_any, literal, strip

#: scheme, authority, path, query, fragment
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*(?=:)"
_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_AUTHORITY = _AFTER_SCHEME + r"//([^/?#]*)"
_PATH = _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"

#: schemes whose last path segment may carry ";parameters", and schemes with an authority
_WITH_PARAMS = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip",
                "sips", "mms", "sftp", "tel")
_WITH_AUTHORITY = ("http", "https", "ftp", "file", "sftp", "ws", "wss", "rtsp", "rsync", "svn", "git", "mms")


def tidy(url: Column) -> Column:
    """``url`` without tabs and line ends, and without control characters or blanks before it."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    """Lower-case scheme, ``""`` if there is none; NULL for NULL."""
    return F.lower(F.regexp_extract(tidy(url), _SCHEME, 0))


def netloc(url: Column) -> Column:
    """Authority as written, ``""`` if there is none."""
    return F.regexp_extract(tidy(url), _AUTHORITY, 1)


def raw_path(url: Column) -> Column:
    """Path with any ``;parameters`` of its last segment."""
    return F.regexp_extract(tidy(url), _PATH, 1)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment (what file-type tests look at)."""
    p = raw_path(url)
    return F.when(scheme(url).isin(*_WITH_PARAMS), F.regexp_replace(p, r"^((?:.*/)?[^/;]*);[^/]*$", "$1")).otherwise(p)


def query(url: Column) -> Column:
    """Query string, ``""`` if there is none."""
    return F.regexp_extract(tidy(url), _QUERY, 1)


def site_form(host: Column) -> Column:
    """The form under which hosts are one site: lower case, one leading ``www.`` gone."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def clean_host(host: Column) -> Column:
    """``site_form`` of a dirty host column: blanks at both ends go first."""
    return site_form(F.regexp_replace(host, r"^\s+|\s+$", ""))


def site_key(url: Column) -> Column:
    """Site of an address."""
    return site_form(netloc(url))


def site_file_stem(host: Column) -> Column:
    """File stem of a site's report."""
    stem = F.replace(host, F.lit(":"), F.lit("_"))
    return F.when(stem == "", F.lit("site")).otherwise(stem)


def same_site(url: Column, host: Column) -> Column:
    """Whether ``url`` belongs to the site of ``host``."""
    return site_key(url) == site_form(host)


def canonical(url: Column, tracking: tuple[str, ...] = rules.TRACKING_PARAMS) -> Column:
    """One spelling for all addresses of a resource.

    Scheme and host in lower case, default port, fragment, repeated slashes and tracking
    parameters gone, the other parameters sorted as strings; a trailing slash and ``;parameters``
    stay. NULL gives NULL; an address with unbalanced brackets in its host comes back unchanged.
    """
    s, raw = scheme(url), netloc(url)
    n = F.lower(raw)
    n = (F.when(s == "http", F.regexp_replace(n, r":80$", ""))
         .when(s == "https", F.regexp_replace(n, r":443$", "")).otherwise(n))
    p = F.regexp_replace(raw_path(url), r"/{2,}", "/")
    p = F.when(s.isin(*_WITH_PARAMS), F.regexp_replace(p, r"^((?:.*/)?[^/;]*);$", "$1")).otherwise(p)
    p = F.when((p == "") | p.startswith(";"), F.concat(F.lit("/"), p)).otherwise(p)
    kept = F.filter(F.split(query(url), "&"),
                    lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).isin(*tracking))
    q = F.array_join(F.array_sort(kept), "&")
    authority = (F.when(n != "", F.concat(F.lit("//"), n, F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))))
                 .when(s.isin(*_WITH_AUTHORITY) & p.startswith("/"), F.concat(F.lit("//"), p)).otherwise(p))
    whole = F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit("")), authority,
                     F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    unbalanced = raw.contains("[") != raw.contains("]")
    return F.when(url.isNull(), F.lit(None).cast("string")).when(unbalanced, url).otherwise(whole)


def url_hash(url: Column) -> Column:
    """Identity of an address in the frontier: hex SHA-1 of its UTF-8 bytes (kind plays no part)."""
    return F.sha1(url)


def offered_key(urlhash: Column, url: Column) -> Column:
    """Key of an offer whose hash may be dirty.

    The hash, trimmed and lower-cased, where that is 40 hex digits; else the hash of the canonical
    address; NULL where neither is usable.
    """
    given = F.lower(F.regexp_replace(urlhash, r"^\s+|\s+$", ""))
    return F.when(given.rlike("^[0-9a-f]{40}$"), given).otherwise(url_hash(canonical(url)))


# --- further forms of an address ----------------------------------------------------------------
def without_query(url: Column) -> Column:
    """Key of a page where queries never make a page: scheme, site form of the host, path; ``/`` for none."""
    p = path(url)
    return F.concat(scheme(url), F.lit("://"), site_key(url), F.when(p == "", F.lit("/")).otherwise(p))


def roaming_form(url: Column) -> Column:
    """Key of a page where the query may be all that names it: host lower-cased, fragment and parameters gone."""
    p, q = path(url), query(url)
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), F.when(p == "", F.lit("/")).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def with_scheme(seed: Column) -> Column:
    """A seed as an address: ``https://`` is put before one without http(s)."""
    return F.when(seed.rlike("^https?://"), seed).otherwise(F.concat(F.lit("https://"), seed))


def homepage(url: Column) -> Column:
    """Front page of an address's host."""
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), F.lit("/"))


def path_prefix(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` non-empty segments of the path: the bucket a cap counts in; ``""`` for the root."""
    return F.array_join(F.slice(F.filter(F.split(raw_path(url), "/"), lambda s: s != ""), 1, depth), "/")


def resolve(base: Column, href: Column) -> Column:
    """Absolute http(s) address of ``href`` on the page ``base``, without fragment; NULL for any other.

    Absolute references, and those from the root of a host without dot segments, are settled in
    the JVM; others (dots, queries alone, paths from the page's folder) by the standard library's
    rules in an Arrow function.
    """
    ready = F.regexp_replace(href, "#.*$", "")
    plain = href.rlike(r"^https?://[^/?#\s\[\]]+(?:/[^\s?#;]*)?(?:\?[^\s#;]+)?(?:#\S*)?$")
    rooted = href.rlike(r"^/(?!/)[^\s;?#]*(?:\?[^\s#;]+)?(?:#[^\s]*)?$") & ~href.rlike(r"^[^?#]*/\.{1,2}(?:/|[?#]|$)") & base.rlike(r"^https?://[^/?#\s\[\]]+")
    relative = F.coalesce(~plain & ~rooted, F.lit(True))
    joined = F.when(plain, ready).when(rooted, F.concat(F.regexp_extract(base, r"^https?://[^/?#\s]+", 0), ready)).otherwise(_joined()(base, F.when(relative, href)))
    return F.when(joined.rlike("^https?://"), joined)


def _joined():
    from urllib.parse import urljoin


    @F.pandas_udf("string")
    def joined(base: pd.Series, href: pd.Series) -> pd.Series:
        def one(b, h):
            if b is None or h is None:
                return None
            try:
                return urljoin(b, h).split("#")[0]
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)

    return joined


# --- what an address says about its page --------------------------------------------------------
def link_priority(url: Column) -> Column:
    """1 for contact-like paths, 3 for archives, 2 for the rest; the first test decides."""
    p = F.lower(path(url))
    return F.when(contains_any(p, rules.HIGH_VALUE_PATH_HINTS), 1).when(contains_any(p, rules.LOW_VALUE_PATH_HINTS), 3).otherwise(2)


def legacy_file(url: Column) -> Column:
    return ends_with_any(F.lower(path(url)), rules.LEGACY_EXTENSIONS)


def flagged_file(url: Column) -> Column:
    return ends_with_any(F.lower(path(url)), rules.FLAGGED_EXTENSIONS)


def sensitive_verdict(url: Column) -> Column:
    """``high`` for file types that should never be public, ``context`` for data files named like a dump, else NULL."""
    p = F.lower(path(url))
    name = F.substring_index(p, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return (F.when(ends_with_any(p, rules.HIGH_SENSITIVE_EXTENSIONS), "high")
            .when(ends_with_any(p, rules.CONTEXT_SENSITIVE_EXTENSIONS) & ~stem.isin(*rules.BENIGN_STEMS) & contains_any(name, rules.DUMPY_HINTS), "context"))


def bot_hostile(host: Column) -> Column:
    """Whether a host is, or is below, one that turns automated clients away."""
    return site_form(host).rlike(r"(?:^|\.)(?:" + "|".join(map(literal, rules.BOT_HOSTILE_HOSTS)) + r")\z")


def unquoted(c: Column) -> Column:
    """Percent-escapes decoded, ``+`` left alone; a value with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def looks_like_url(value: Column) -> Column:
    v = F.lower(strip(value))
    return v.rlike(r"^(?:https?://|//|/\\|\\\\)") | v.contains("://")


def risky_params(url: Column) -> Column:
    """Reasons, in the order of the query, why parameters deserve a look; empty for none."""

    def reasons(kv: Column) -> Column:
        name, raw = F.substring_index(kv, "=", 1), F.when(kv.contains("="), F.regexp_replace(kv, "^[^=]*=", "")).otherwise(F.lit(""))
        low_name, value = F.lower(name), unquoted(raw)
        cut = F.substring(value, 1, 60)
        say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        url_like = F.when(looks_like_url(value), F.when(low_name.isin(*rules.REDIRECT_PARAM_NAMES), say(name, "= points at a URL (", cut, ") - open-redirect/SSRF candidate"))
                          .otherwise(say(name, "= carries a URL (", cut, ") - possible SSRF/redirect")))
        path_like = (F.when(value.contains("../") | value.contains("..\\") | F.lower(raw).contains("%2e%2e"), say(name, "= contains path traversal (", cut, ")"))
                     .when(F.lower(value).rlike(rules.FILESYSTEM_PATH), say(name, "= looks like a filesystem path (", cut, ")")))
        toggle = F.when(low_name.isin(*rules.TOGGLE_PARAM_NAMES) & F.lower(value).isin(*rules.TRUTHY_VALUES), say(name, "=", value, " - debug/admin toggle enabled"))
        return F.filter(F.array(url_like, path_like, toggle), lambda r: r.isNotNull())

    return F.flatten(F.transform(F.filter(F.split(query(url), "&"), lambda kv: kv != ""), reasons))
