"""What a response says: status classes, headers, cookies, soft 404s, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import urls
from quarrylight.functions.match import contains_any, strip
from quarrylight.functions.text import body_signature


def confirmed_status(head: Column, get: Column) -> Column:
    """Status of a probe: a failing HEAD other than a rate limit is confirmed by GET."""
    return F.when((head >= 400) & ~head.isin(*rules.RATE_LIMIT_CODES), get).otherwise(head)


def status_detail(status: Column, redirected: Column, final_url: Column) -> Column:
    s = status.cast("string")
    return F.when(redirected, F.concat(s, F.lit(" (after redirect to "), final_url, F.lit(")"))).otherwise(s)


def page_class(status: Column, error: Column) -> Column:
    """Finding category of a page's status; a rate limit wins over a security code, NULL is none."""
    return (F.when(error.isNotNull(), "broken").when(status.isin(*rules.RATE_LIMIT_CODES), "rate_limited").when(status.isin(*rules.BROKEN_STATUS_CODES), "broken")
            .when(status.isin(*rules.SECURITY_STATUS_CODES), "security_code").when(status >= 400, "broken"))


def page_detail(status: Column, error: Column, redirected: Column, final_url: Column, attempts: Column) -> Column:
    s = status.cast("string")
    return (F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).when(status.isin(*rules.RATE_LIMIT_CODES), F.concat(s, F.lit(" after "), attempts.cast("string"), F.lit(" tries (could not verify)")))
            .when(status.isin(*rules.SECURITY_STATUS_CODES), s).otherwise(status_detail(status, redirected, final_url)))


def resource_class(status: Column, error: Column, url: Column, source: Column) -> Column:
    """Finding category of a resource's status, seen from the site that refers to it."""
    host = urls.site_key(url)
    cross = (host != "") & (host != urls.site_key(source))
    return (F.when(urls.bot_hostile(host), "unverified_resource").when(error.isNotNull(), "broken_resource").when(status.isin(*rules.RATE_LIMIT_CODES), "rate_limited")
            .when((status >= 400) & cross & status.isin(401, 403), "unverified_resource").when(status >= 400, "broken_resource"))


def resource_detail(status: Column, error: Column, url: Column, source: Column, redirected: Column, final_url: Column) -> Column:
    s, host = status.cast("string"), urls.site_key(url)
    cross = (host != "") & (host != urls.site_key(source))
    return (F.when(urls.bot_hostile(host), F.concat(host, F.lit(" blocks automated clients - not checked (links there are virtually never actually broken)")))
            .when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).when(status.isin(*rules.RATE_LIMIT_CODES), F.concat(s, F.lit(" after retries (could not verify)")))
            .when((status >= 400) & cross & status.isin(401, 403), F.concat(s, F.lit(" (cross-origin, likely bot-blocked - not confirmed broken)")))
            .otherwise(status_detail(status, redirected, final_url)))


def probe_detail(status: Column) -> Column:
    """What a probed path that nothing links to shows; NULL for nothing."""
    s = status.cast("string")
    return F.when(status.isin(*rules.RATE_LIMIT_CODES), None).when(status < 400, F.concat(s, F.lit(" reachable"))).when(status.isin(401, 403), F.concat(s, F.lit(" present but protected")))


def header(headers: Column, name: str) -> Column:
    """Value of a header, whatever the case of its name."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), F.lit(0))


def missing_security_headers(headers: Column) -> Column:
    """Names of the five headers a response lacks, in order; all of them for NULL headers."""
    there = F.transform(F.coalesce(F.map_keys(headers), F.array().cast("array<string>")), F.lower)
    return F.filter(F.array(*map(F.lit, rules.SECURITY_HEADERS)), lambda h: ~F.array_contains(there, F.lower(h)))


def version_disclosure(headers: Column) -> Column:
    """``name: value`` of headers that tell a version, joined by ``; ``; NULL for none."""
    parts = []
    for name in rules.VERSION_DISCLOSURE_HEADERS:
        value = header(headers, name)
        tells = (value != "") & (F.lit(True) if name.lower().startswith("x-") else value.rlike(r"\d"))
        parts.append(F.when(tells, F.concat(F.lit(f"{name}: "), value)))
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def cookie_flags(name: Column, secure: Column, httponly: Column, samesite: Column) -> Column:
    """Which flags a cookie lacks, as a finding's detail; NULL for none."""
    lacks = F.filter(F.array(F.when(~secure, "Secure"), F.when(~httponly, "HttpOnly"), F.when(~samesite, "SameSite")), lambda x: x.isNotNull())
    return F.when(F.size(lacks) > 0, F.concat(F.lit("cookie '"), name, F.lit("' missing: "), F.array_join(lacks, ", ")))


def header_eggs(headers: Column) -> Column:
    """``name: value`` of headers a person wrote for people to read."""

    def keep(e: Column) -> Column:
        low, v = F.lower(e["key"]), strip(e["value"])
        human = low.startswith("x-") & ~low.isin(*rules.BORING_HEADERS) & ~contains_any(F.lower(v), rules.BORING_HEADER_VALUES) & v.rlike(r"[a-zA-Z]{3,}\s+[a-zA-Z]{3,}") & v.contains(" ") & (F.length(v) <= 120)
        return F.when(low == "x-clacks-overhead", F.concat(e["key"], F.lit(": "), e["value"])).when(human, F.concat(e["key"], F.lit(": "), v))

    return F.filter(F.transform(F.map_entries(headers), keep), lambda x: x.isNotNull())


def humans_txt(status: Column, content_type: Column, body: Column) -> Column:
    """Text of a real humans.txt, cut at 4,000 characters (a limit of the report, as in the data's contract), else NULL."""
    text = strip(body)
    fine = (status < 400) & ~F.coalesce(content_type, F.lit("")).contains("html") & (F.length(text) >= 15) & ~F.lower(text).contains("<html")
    return F.when(fine, F.substring(text, 1, 4000))


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header; dates and rubbish give NULL, negatives 0."""
    seconds = strip(value).try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def transient_backoff(attempt: Column) -> Column:
    """Seconds before the next try after a momentary failure: 1, 2, 4, then 8."""
    return F.least(F.pow(F.lit(2.0), attempt.cast("double")), F.lit(8.0))


def cooldown(streak: Column, retry: Column) -> Column:
    """Seconds a host is left alone after its n-th rate limit in a row: doubling from 2, at least what it asks for, 60 at most."""
    return F.least(F.greatest(F.lit(2.0) * F.pow(F.lit(2.0), (streak - 1).cast("double")), F.coalesce(retry, F.lit(0.0))), F.lit(60.0))


def is_html(content_type: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).contains("html")


def is_script(content_type: Column, url: Column) -> Column:
    return F.lower(urls.path(url)).endswith(".js") | F.coalesce(content_type, F.lit("")).contains("javascript")


def directory_listing(body: Column) -> Column:
    return body.rlike(rules.DIRECTORY_LISTING)


# --- soft 404s ----------------------------------------------------------------------------------
def soft404_profile(status: Column, error: Column, redirected: Column, final_url: Column, body: Column, home_status: Column, home_body: Column, base: Column) -> Column:
    """STRUCT<mode, landing, sig> of a host, from its answers for a page that can't exist and for its front page."""
    landing, sig = urls.canonical(final_url), body_signature(body, final_url)
    at_root = F.regexp_replace(urls.path(landing), "/+$", "") == ""
    home = body_signature(home_body, F.concat(base, F.lit("/")))
    mode = (F.when(error.isNotNull() | status.isNull() | (status >= 400), "honest").when(redirected & at_root, "rootredir").when(redirected, "redirect")
            .when((home_status < 400) & (home == sig), "spa").otherwise("soft200"))
    return F.struct(mode.alias("mode"), F.when(mode.isin("rootredir", "redirect"), landing).alias("landing"), F.when(mode == "soft200", sig).alias("sig"))


def soft404_reason(profile: Column, url: Column, final_url: Column, redirected: Column, body: Column) -> Column:
    """Why a page is a not-found page in disguise, else NULL; a NULL body leaves the redirect test."""
    landed = (profile["mode"] == "redirect") & redirected & (urls.canonical(final_url) == profile["landing"]) & (urls.canonical(url) != profile["landing"])
    same = (profile["mode"] == "soft200") & ~redirected & body.isNotNull() & (body_signature(body, url) == profile["sig"])
    return (F.when(landed, F.concat(F.lit("redirects to "), profile["landing"], F.lit(" (this site's not-found page)")))
            .when(same, F.lit("returns 200 but the body matches this site's not-found page")))


def soft404_caveat(mode: Column) -> Column:
    return (F.when(mode == "spa", "returns 200 for unknown URLs (single-page-app / catch-all) - broken links can't be confirmed by HTTP status on this host")
            .when(mode == "rootredir", "redirects unknown URLs to the homepage - dead links may be silently masked, so broken-link results here are best-effort"))
