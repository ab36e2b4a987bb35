"""SQL twins of the core queries, for an engine with RE2 patterns and list lambdas."""

from __future__ import annotations

from quarrylight import rules


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_O = "o AS (SELECT DISTINCT offer_id, kind, url, source, depth, state FROM frontier WHERE url IS NOT NULL)"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_NETLOC = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_RAW_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_PATH = f"regexp_replace({_RAW_PATH}, '^((?:.*/)?[^/;]*);[^/]*$', '\\1')"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_SITE = rf"regexp_replace(lower({_NETLOC}), '^www\.', '')"
_SLASH = f"CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END"
_WITHOUT = f"({_SCHEME} || '://' || {_SITE} || {_SLASH})"
_BUCKET = f"coalesce(list_filter(string_split({_RAW_PATH}, '/'), lambda s: s <> '')[1], '')"
_KEPT = f"array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda kv: kv <> '' AND lower(split_part(kv, '=', 1)) NOT IN ({_in(rules.TRACKING_PARAMS)}))), '&')"
_CANON = (f"({_SCHEME} || '://' || CASE WHEN {_SCHEME} = 'http' THEN regexp_replace(lower({_NETLOC}), ':80$', '') WHEN {_SCHEME} = 'https' THEN regexp_replace(lower({_NETLOC}), ':443$', '') ELSE lower({_NETLOC}) END"
          f" || CASE WHEN {_RAW_PATH} = '' THEN '/' ELSE regexp_replace({_RAW_PATH}, '/{{2,}}', '/', 'g') END || CASE WHEN coalesce({_KEPT}, '') = '' THEN '' ELSE '?' || {_KEPT} END)")
_CLEAN_HOST = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '^www\.', '')"
_NET = _CLEAN_HOST.format("netloc")
_CLEAN = rf"""f AS (SELECT DISTINCT {_NET} AS netloc, lower(regexp_replace(category, '^\s+|\s+$', '', 'g')) AS category, url, detail, found_on, kind FROM findings WHERE netloc IS NOT NULL)"""
_PAIRS = f"{_CLEAN}, p AS (SELECT netloc, category, count(*) AS findings FROM f GROUP BY ALL)"
_DISPLAY = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.FINDING_CATEGORIES) + " ELSE {} END"
_SEVERITY = f"CASE WHEN split_part(category, ' (', 1) IN ({_in(rules.CRITICAL_CATEGORIES)}) THEN 'critical' WHEN split_part(category, ' (', 1) IN ({_in(rules.WARNING_CATEGORIES)}) THEN 'warning' ELSE 'none' END"
_KEY = rf"CASE WHEN regexp_full_match(lower(regexp_replace(urlhash, '^\s+|\s+$', '', 'g')), '[0-9a-f]{{40}}') THEN lower(regexp_replace(urlhash, '^\s+|\s+$', '', 'g')) ELSE sha1({_CANON}) END"
_EMAILS = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{rules.EMAIL}'), lambda e: lower(e)), lambda e: list_last(string_split(e, '.')) NOT IN ({_in(rules.FILE_EXT_FALSE_POSITIVES)}))))"
_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_STATUS = "CASE {0} % 10 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 403 WHEN 3 THEN 500 WHEN 4 THEN 418 ELSE 200 END"
_HEADERS = "from_json(missing_headers, '[\"VARCHAR\"]')"


def _pick(words, n) -> str:
    return f"[{_in(words)}][CAST(offer_id % {n} AS INT) + 1]"


def _like_any(c, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _ends_any(c, words) -> str:
    return "(" + " OR ".join(f"ends_with({c}, '{w}')" for w in words) + ")"


def _word_test(words) -> str:
    def one(w):
        q = "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in w.strip()).replace("'", "''")
        return ("(?:^|[^a-z0-9])" if w.strip()[:1].isalnum() else "") + q + ("(?:[^a-z0-9]|$)" if w.strip()[-1:].isalnum() else "")

    return "(" + " OR ".join(f"regexp_matches(lower(coalesce(text, '')), '{one(w)}')" for w in words) + ")"


_FILE = f"({_WITHOUT} || {_pick(('/db.sql', '/users_export.csv', '/sitemap.xml', '/data.json', '/a.PDF', '/notes.txt', ''), 7)})"
_FPATH = rf"lower(regexp_extract(u, '^[a-z]+://[^/]*(.*)$', 1))"
_FNAME = f"list_last(string_split({_FPATH}, '/'))"

_LACKING = "[" + ",".join(f'"{h}"' for h in rules.SECURITY_HEADERS if h.lower() != "x-frame-options") + "]"
_SOURCE_SITE = _SITE.replace("(url,", "(coalesce(source, url),")
_RESOURCES = f"""{_O}, r AS (SELECT kind, offer_id % 31 = 0 AS failed, {_STATUS.format('offer_id')} AS status, {_SITE} AS host, {_SOURCE_SITE} AS netloc, lower({_PATH}) AS path FROM o WHERE kind <> 'page'),
c AS (SELECT *, NOT failed AND status < 400 AS fine, list_last(string_split(path, '/')) AS name,
  CASE WHEN failed THEN 'broken_resource' WHEN status IN (429, 503) THEN 'rate_limited' WHEN status IN (401, 403) AND host <> '' AND host <> netloc THEN 'unverified_resource' WHEN status >= 400 THEN 'broken_resource' END AS category FROM r)"""

# --- crawls: offers as a tree of pages, a level a wave -------------------------------------------
_LEVELS = 17  # three to the 17th is more than the offers of any table here
_HOST = rf"regexp_replace({_SITE}, ':\d*$', '')"
_PRIORITY = f"CASE WHEN {_like_any('lower(path)', rules.HIGH_VALUE_PATH_HINTS)} THEN 1 WHEN {_like_any('lower(path)', rules.LOW_VALUE_PATH_HINTS)} THEN 3 ELSE 2 END"


def _nodes(asked: bool) -> str:
    plain = "CASE WHEN b = '' THEN '' ELSE '/' || b END || '/o' || o"
    whole = f"CASE WHEN o % 2 = 0 THEN '/' || b || '?o=' || o ELSE {plain} END" if asked else plain
    return f"""{_O}, b AS (SELECT DISTINCT offer_id AS o, {_HOST} AS host, {_BUCKET} AS b FROM o),
n AS MATERIALIZED (SELECT o, o // 3 AS parent, host, b, host || {whole} AS at, 'https://' || host || {whole} AS url, {plain} AS path, CASE WHEN b = '' AND {'o % 2 = 1' if asked else 'true'} THEN 'o' || o ELSE b END AS bucket FROM b)"""


def _levels(kept: str) -> str:
    """CTEs w1, w2, ...: ``kept`` (a select over c, the children of the level before, and u, all levels before) makes each."""
    out = ["w0 AS (SELECT * FROM n WHERE false)"]
    for k in range(1, _LEVELS + 1):
        children = "SELECT * FROM n WHERE parent = 0" if k == 1 else f"SELECT n.* FROM n JOIN w{k - 1} w ON n.parent = w.o"
        before = " UNION ALL ".join(f"SELECT o, host, bucket, url, b FROM w{j}" for j in range(k))
        out.append(f"w{k} AS MATERIALIZED (WITH c AS MATERIALIZED ({children}), u AS MATERIALIZED ({before}) {kept})")
    return ",\n".join(out)


_ALL = " UNION ALL ".join(f"SELECT *, {k} AS depth FROM w{k}" for k in range(1, _LEVELS + 1))


def _capped() -> str:
    """CTEs c1, p1, w1, c2, ...: the children of a level, what the cap of prefixes admits of them, and what that of queries leaves."""
    out = []
    for k in range(1, _LEVELS + 1):
        children = "SELECT * FROM n WHERE parent = 0" if k == 1 else f"SELECT n.* FROM n JOIN w{k - 1} w ON n.parent = w.o"
        before = lambda t, key, where: " UNION ALL ".join([f"SELECT host, {key}, count(*) AS n FROM {t}{j} WHERE {where} GROUP BY ALL" for j in range(1, k)] or [f"SELECT host, {key}, 0 AS n FROM n WHERE false"])
        out += [f"c{k} AS MATERIALIZED ({children})",
                f"p{k} AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT c.*, row_number() OVER (PARTITION BY host, bucket ORDER BY o) + coalesce(x.m, 0) AS r FROM c{k} c LEFT JOIN (SELECT host, bucket, sum(n) AS m FROM ({before('p', 'bucket', 'true')}) GROUP BY ALL) x USING (host, bucket)) WHERE bucket = '' OR r <= 8)",
                f"w{k} AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT c.*, row_number() OVER (PARTITION BY host, b, o % 2 ORDER BY o) + coalesce(x.m, 0) AS r FROM p{k} c LEFT JOIN (SELECT host, b, sum(n) AS m FROM ({before('w', 'b', 'o % 2 = 0')}) GROUP BY ALL) x USING (host, b)) WHERE o % 2 = 1 OR r <= 3)"]
    return ",\n".join(out)


_COUNTS = " UNION ALL ".join(f"SELECT host, bucket, b, o, '{t}' AS t FROM {t}{k}" for k in range(1, _LEVELS + 1) for t in "cpw")
SQL_CRAWLS = {
    "crawl_waves": f"WITH RECURSIVE {_nodes(False)}, t AS (SELECT o, url, 'https://start.test/' AS source, 1 AS depth FROM n WHERE parent = 0 UNION ALL SELECT n.o, n.url, t.url, t.depth + 1 FROM t JOIN n ON n.parent = t.o) SELECT url, source, depth, depth AS wave FROM t UNION ALL SELECT 'https://start.test/', 'https://start.test/', 0, 0",
    "crawl_host_cap": f"WITH {_nodes(False)}, " + _levels(f"SELECT * EXCLUDE (r) FROM (SELECT c.*, row_number() OVER (PARTITION BY host ORDER BY {_PRIORITY}, o) + coalesce(x.n, 0) AS r FROM c LEFT JOIN (SELECT host, count(*) AS n FROM u GROUP BY host) x USING (host)) WHERE r <= 40") + f" SELECT url FROM ({_ALL}) UNION ALL SELECT 'https://start.test/'",
    "crawl_capped": f"WITH {_nodes(True)}, {_capped()} SELECT url, depth FROM ({_ALL}) UNION ALL SELECT 'https://start.test/', 0",
    "crawl_skips": f"WITH {_nodes(True)}, {_capped()}, a AS MATERIALIZED ({_COUNTS}) SELECT host AS netloc, count(*) FILTER (t = 'c' AND bucket <> '') - count(*) FILTER (t = 'p' AND bucket <> '') AS pattern_skipped, count(*) FILTER (t = 'p' AND o % 2 = 0) - count(*) FILTER (t = 'w' AND o % 2 = 0) AS query_skipped FROM a WHERE bucket <> '' OR o % 2 = 0 GROUP BY host",
    "deep_audit_findings": f"""WITH RECURSIVE {_nodes(False)}, s AS (SELECT *, CASE WHEN o % 3 = 2 THEN {_STATUS.format('o')} ELSE 200 END AS status FROM n),
t AS (SELECT o, url, host, status, 1 AS depth FROM s WHERE parent = 0 UNION ALL SELECT s.o, s.url, s.host, s.status, t.depth + 1 FROM t JOIN s ON s.parent = t.o WHERE t.status < 400 AND t.o % 10 <> 7),
f AS (SELECT * FROM t WHERE o % 10 <> 7),
i AS (SELECT k, arg_min(host, CAST(depth AS BIGINT) * 1000000000000 + o) AS host, {_STATUS.format('k')} AS status FROM (SELECT o % 20 AS k, host, depth, o FROM f WHERE status < 400 UNION ALL SELECT 0, 'start.test', 0, 0) GROUP BY k),
r AS (SELECT host AS netloc, CASE WHEN status = 503 THEN 'rate_limited' WHEN status IN (403, 500) THEN 'security_code' ELSE 'broken' END AS category FROM f WHERE status >= 400
  UNION ALL SELECT host, CASE status WHEN 503 THEN 'rate_limited' WHEN 403 THEN 'unverified_resource' ELSE 'broken_resource' END FROM i WHERE status >= 400 UNION ALL SELECT 'start.test', 'version_disclosure')
SELECT netloc, category, count(*) AS n FROM r GROUP BY ALL""",
    "deep_audit_stats": f"""WITH RECURSIVE {_nodes(False)}, s AS (SELECT *, CASE WHEN o % 3 = 2 THEN {_STATUS.format('o')} ELSE 200 END AS status FROM n),
t AS (SELECT o, host, status FROM s WHERE parent = 0 UNION ALL SELECT s.o, s.host, s.status FROM t JOIN s ON s.parent = t.o WHERE t.status < 400 AND t.o % 10 <> 7)
SELECT host AS netloc, count(*) FILTER (o % 10 <> 7) AS pages_crawled, count(*) FILTER (o % 10 = 7) AS robots_blocked FROM t GROUP BY host UNION ALL SELECT 'start.test', 1, 0""",
}

SQL = SQL_CRAWLS | {
    "p5_found": f"WITH {_PAIRS} SELECT netloc, category FROM p WHERE findings * 100 >= (SELECT count(*) FROM f)",
    "p5_pair_rollup": rf"WITH {_PAIRS}, s AS (SELECT regexp_replace(lower(trim(netloc)), '^www\.', '') AS netloc, sum(pages_crawled) AS pages FROM site_stats GROUP BY 1) SELECT netloc, category, findings, (SELECT count(*) FROM f) AS all_findings, CAST(pages AS BIGINT) AS pages FROM p LEFT JOIN s USING (netloc)",
    "url_split": f"WITH {_O} SELECT offer_id, {_SCHEME} AS scheme, {_NETLOC} AS netloc, {_RAW_PATH} AS path, {_QUERY} AS query FROM o",
    "url_canonical": f"WITH {_O} SELECT offer_id, {_CANON} AS canonical, sha1({_CANON}) AS hash FROM o",
    "url_without_query": f"WITH {_O} SELECT offer_id, {_WITHOUT} AS page FROM o",
    "url_roaming_form": f"WITH {_O} SELECT offer_id, {_SCHEME} || '://' || lower({_NETLOC}) || {_SLASH} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS page, {_SCHEME} || '://' || lower({_NETLOC}) || '/' AS home FROM o",
    "url_site_rollup": f"WITH {_O} SELECT {_SITE} AS site, count(*) AS offers, count(DISTINCT kind) AS kinds, min(depth) AS least_depth, replace({_SITE}, ':', '_') AS stem FROM o GROUP BY {_SITE}",
    "url_resolved": f"WITH {_O} SELECT offer_id, {_SCHEME} || '://' || lower({_NETLOC}) || '/a/p' || offer_id || '?q=1' AS target FROM o WHERE kind = 'page'",
    "url_seed_form": f"WITH {_O} SELECT DISTINCT 'https://' || {_SITE} AS seed FROM o",
    "tracking_params_stripped": f"WITH {_O}, k AS (SELECT lower(split_part(unnest(list_filter(string_split({_QUERY}, '&'), lambda kv: kv <> '')), '=', 1)) AS name FROM o) SELECT name, count(*) AS n FROM k WHERE name IN ({_in(rules.TRACKING_PARAMS)}) GROUP BY name",
    "url_prefix_bucket": f"WITH {_O} SELECT {_SITE} AS site, {_BUCKET} AS bucket, count(*) AS n FROM o GROUP BY 1, 2",
    "prefix_cap": f"WITH {_O}, b AS (SELECT offer_id, {_SITE} AS site, {_BUCKET} AS bucket FROM o) SELECT offer_id, site, bucket FROM b WHERE bucket <> '' QUALIFY row_number() OVER (PARTITION BY site, bucket ORDER BY offer_id) <= 3",
    "prefix_cap_skips": f"WITH {_O}, b AS (SELECT {_SITE} AS site, {_BUCKET} AS bucket FROM o) SELECT site, bucket, count(*) - 3 AS skipped FROM b WHERE bucket <> '' GROUP BY site, bucket HAVING count(*) > 3",
    "query_variant_cap": f"WITH {_O}, b AS (SELECT offer_id, {_SITE} AS site, {_RAW_PATH} AS path, {_QUERY} AS query FROM o) SELECT * FROM b WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY offer_id) <= 1",
    "link_priority_order": f"WITH {_O} SELECT offer_id, CASE WHEN {_like_any(f'lower({_PATH})', rules.HIGH_VALUE_PATH_HINTS)} THEN 1 WHEN {_like_any(f'lower({_PATH})', rules.LOW_VALUE_PATH_HINTS)} THEN 3 ELSE 2 END AS priority FROM o",
    "sensitive_files": f"WITH {_O}, x AS (SELECT offer_id, {_FILE} AS u FROM o), y AS (SELECT offer_id, {_FPATH} AS p, {_FNAME} AS n FROM x) SELECT offer_id, CASE WHEN {_ends_any('p', rules.HIGH_SENSITIVE_EXTENSIONS)} THEN 'high' WHEN {_ends_any('p', rules.CONTEXT_SENSITIVE_EXTENSIONS)} AND regexp_replace(n, '\\.[^.]*$', '') NOT IN ({_in(rules.BENIGN_STEMS)}) AND {_like_any('n', rules.DUMPY_HINTS)} THEN 'context' END AS verdict, {_ends_any('p', rules.LEGACY_EXTENSIONS)} AS legacy, {_ends_any('p', rules.FLAGGED_EXTENSIONS)} AS flagged FROM y",
    "risky_params": f"WITH {_O} SELECT r AS reason, count(*) AS n FROM (SELECT {_pick(('next= points at a URL (https://e.test/x) - open-redirect/SSRF candidate', 'f= contains path traversal (../../etc)', 'p= looks like a filesystem path (/etc/passwd)', 'debug=1 - debug/admin toggle enabled', '', 'ref= carries a URL (//k.test) - possible SSRF/redirect'), 6)} AS r FROM o) WHERE r <> '' GROUP BY r",
    "bot_hostile": f"WITH {_O}, h AS (SELECT CASE WHEN offer_id % 5 = 0 THEN {_pick(('www.facebook.com', 'm.x.com', 'netflix.com', 'a.linkedin.com'), 4)} ELSE {_NETLOC} END AS host FROM o) SELECT host, count(*) AS n, host IN ('www.facebook.com', 'm.x.com', 'a.linkedin.com') AS hostile FROM h GROUP BY host",
    "hosts_below_domains": f"WITH {_O}, h AS (SELECT offer_id, {_SITE} AS h FROM o) SELECT offer_id FROM h WHERE EXISTS (SELECT 1 FROM site_stats s WHERE (h.h = s.netloc OR ends_with(h.h, '.' || s.netloc)))",
    "frontier_state_counts": "SELECT CAST(s AS INT) AS state, count(offer_id) AS n FROM range(3) r(s) LEFT JOIN (SELECT DISTINCT offer_id, state FROM frontier) f ON f.state = s GROUP BY s",
    "frontier_pending": "SELECT count(*) FILTER (state = 0) AS pending, count(*) FILTER (state = 1) AS active FROM (SELECT DISTINCT offer_id, state FROM frontier)",
    "frontier_dedupe": f"WITH k AS (SELECT {_KEY} AS key, offer_id, kind, depth FROM frontier) SELECT key, offer_id, kind, depth FROM k WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY offer_id) = 1",
    "frontier_scope": f"WITH {_O} SELECT offer_id FROM o WHERE {_SITE} IN (SELECT {_NET} FROM findings WHERE netloc IS NOT NULL)",
    "frontier_unseen": f"WITH {_O}, c AS (SELECT offer_id, state, {_CANON} AS page FROM o) SELECT offer_id, page FROM c WHERE state = 0 AND page NOT IN (SELECT page FROM c WHERE state = 2)",
    "frontier_page_cap": f"WITH {_O}, c AS (SELECT offer_id, {_NETLOC} AS host FROM o WHERE kind = 'page') SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY host ORDER BY offer_id) <= 25",
    "frontier_first_depth": f"WITH {_O}, c AS (SELECT {_CANON} AS page, offer_id, depth, source FROM o) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY offer_id, depth, source) = 1",
    "frontier_bfs": "WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem), t AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node WHERE t.depth < 3) SELECT node, min(depth) AS depth FROM t GROUP BY node",
    "probe_matrix": f"WITH {_O}, r AS (SELECT DISTINCT {_SCHEME} || '://' || lower({_NETLOC}) AS source FROM o) SELECT source || p AS url, source FROM r, (SELECT unnest([{_in(rules.COMMON_PROBE_PATHS)}]) AS p)",
    "finding_distinct": "SELECT DISTINCT netloc, category, url, detail, found_on, kind FROM findings",
    "finding_counts": "SELECT netloc, category, count(*) AS n FROM (SELECT DISTINCT netloc, category, url, detail, found_on, kind FROM findings) GROUP BY netloc, category",
    "finding_summary": f"WITH {_CLEAN} SELECT netloc, " + ", ".join(f"count(*) FILTER (category = '{k}') AS {k}" for k, _ in rules.FINDING_CATEGORIES) + " FROM f GROUP BY netloc",
    "finding_first_per_site": f"WITH f AS (SELECT {_NET} AS netloc, category, id, url FROM findings WHERE netloc IS NOT NULL) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY netloc, category ORDER BY id) = 1",
    "finding_severity": f"WITH r AS (SELECT {_DISPLAY.format('lower(trim(category))', 'category')} AS category FROM findings) SELECT category, count(*) AS n, {_SEVERITY} AS severity FROM r GROUP BY category",
    "report_search": "SELECT id FROM findings WHERE category IN ('broken', 'broken_resource', 'secret') AND contains(lower(concat_ws(' ', coalesce(category, ''), coalesce(detail, ''), coalesce(url, ''), coalesce(found_on, ''))), 'header')",
    "report_mixed_sort": "SELECT DISTINCT coalesce(detail, '') AS detail FROM findings",
    "sites_with_data": f"SELECT netloc FROM site_stats UNION SELECT {_NET} FROM findings WHERE netloc IS NOT NULL",
    "site_counters": f"WITH {_O} SELECT {_SITE} AS netloc, count(*) FILTER (offer_id % 4 = 0) AS pages_crawled, count(*) FILTER (offer_id % 4 = 1) AS robots_blocked, count(*) FILTER (offer_id % 4 = 2) AS pattern_skipped, count(*) FILTER (offer_id % 4 = 3) AS query_skipped FROM o GROUP BY 1",
    "stats_full_outer": rf"WITH f AS (SELECT {_NET} AS netloc, count(*) AS findings FROM findings WHERE netloc IS NOT NULL GROUP BY 1), s AS (SELECT {_NET} AS netloc, pages_crawled, robots_blocked, pattern_skipped, query_skipped FROM site_stats) SELECT netloc, coalesce(pages_crawled, 0) AS pages_crawled, coalesce(robots_blocked, 0) AS robots_blocked, coalesce(pattern_skipped, 0) AS pattern_skipped, coalesce(query_skipped, 0) AS query_skipped, coalesce(findings, 0) AS findings FROM s FULL JOIN f USING (netloc)",
    "missing_headers": "SELECT netloc, unnest(regexp_extract_all(missing_headers, '\"([^\"]*)\"', 1)) AS header FROM site_stats WHERE json_valid(missing_headers)",
    "finds_hall_of_fame": "SELECT find_id, kind, score, ts FROM finds ORDER BY coalesce(score, 0) DESC, coalesce(ts, ''), find_id LIMIT 40",
    "finds_recent": "SELECT find_id, kind FROM finds ORDER BY find_id DESC LIMIT 80",
    "finds_per_kind": "SELECT find_id, kind FROM finds WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY find_id DESC) <= 120",
    "finds_cap_per_domain": f"WITH f AS (SELECT find_id, {_CLEAN_HOST.format('domain')} AS domain FROM finds WHERE domain IS NOT NULL) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY domain ORDER BY find_id) <= 25",
    "finds_counts": f"SELECT {_CLEAN_HOST.format('domain')} AS domain, count(*) AS n, count(DISTINCT kind) AS kinds, max(score) AS best FROM finds GROUP BY 1",
    "find_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM finds) GROUP BY tag",
    "keyword_signals": "SELECT find_id, " + ", ".join(f"{_word_test(rules.STRONG_SIGNALS[t])} AS {t.replace('-', '_')}" for t in ("hiring", "greeting", "easter-egg", "confession")) + " FROM finds",
    "emails_found": f"SELECT doc_id, unnest({_EMAILS}) AS email FROM documents",
    "emails_first_seen": f"WITH e AS (SELECT doc_id, {_CLEAN_HOST.format('domain')} AS site, unnest({_EMAILS}) AS email FROM documents) SELECT site, email, min(doc_id) AS first_doc, count(*) AS docs FROM e GROUP BY site, email",
    "shannon_entropy": "WITH h AS (SELECT DISTINCT offer_id, urlhash FROM frontier WHERE urlhash IS NOT NULL), c AS (SELECT offer_id, urlhash, length(urlhash) AS len, unnest(string_split(urlhash, '')) AS ch FROM h), g AS (SELECT offer_id, urlhash, len, ch, count(*) AS n FROM c GROUP BY ALL) SELECT offer_id, CASE WHEN max(len) = 0 THEN 0.0 ELSE round(abs(sum(n / greatest(len, 1) * log2(n / greatest(len, 1)))), 6) END AS entropy FROM g GROUP BY offer_id, urlhash",
    "secret_mask": "SELECT offer_id, CASE WHEN length(urlhash) <= 8 THEN repeat('*', length(urlhash)) ELSE left(urlhash, 4) || repeat('*', length(urlhash) - 8) || right(urlhash, 4) END AS masked FROM (SELECT DISTINCT offer_id, urlhash FROM frontier WHERE urlhash IS NOT NULL)",
    "corpus_dedupe": f"WITH l AS (SELECT doc_id, {_COLLAPSE.format('unnest(string_split(text, chr(10)))')} AS paragraph FROM documents) SELECT sha1(paragraph) AS paragraph, min(doc_id) AS doc_id FROM l WHERE len(string_split(paragraph, ' ')) >= 5 GROUP BY l.paragraph",
    "escaped_text": "SELECT doc_id, sha1(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS hash FROM documents WHERE text IS NOT NULL",
    "page_status_class": f"WITH {_O}, r AS (SELECT {_SITE} AS netloc, offer_id, {_STATUS.format('offer_id')} AS status FROM o WHERE kind = 'page'), c AS (SELECT netloc, CASE WHEN offer_id % 31 = 0 THEN 'broken' WHEN status IN (429, 503) THEN 'rate_limited' WHEN status IN (404, 410) THEN 'broken' WHEN status IN (403, 500) THEN 'security_code' WHEN status >= 400 THEN 'broken' END AS category FROM r) SELECT category, netloc, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY category, netloc",
    "head_confirmed": f"WITH {_O}, r AS (SELECT offer_id, {_STATUS.format('offer_id')} AS h, {_STATUS.format('(offer_id + 3)')} AS g FROM o) SELECT offer_id, CASE WHEN h >= 400 AND h NOT IN (429, 503) THEN g ELSE h END AS status FROM r",
    "retry_backoff": f"WITH {_O}, r AS (SELECT DISTINCT CAST(offer_id % 12 AS INT) AS n FROM o) SELECT n, least(pow(2.0, n), 8.0) AS transient, least(greatest(2.0 * pow(2.0, n), CASE WHEN n % 3 = 0 THEN 30.0 ELSE 0.0 END), 60.0) AS cooldown FROM r",
    "page_links": f"WITH {_O}, p AS (SELECT DISTINCT url, offer_id FROM o WHERE kind = 'page' AND offer_id % 31 <> 0 AND offer_id % 10 > 4), l AS (SELECT DISTINCT url, offer_id, {_SCHEME} || '://' || {_NETLOC} AS root FROM p), t AS (SELECT DISTINCT url, root || '/n/' || (offer_id % 50) AS target, 'page' AS kind FROM l UNION SELECT DISTINCT url, 'https://k.test/', 'page' FROM l UNION ALL SELECT url, root || '/s.css', 'stylesheet' FROM l UNION ALL SELECT url, 'http://i.test/' || (offer_id % 20) || '.png', 'image' FROM l) SELECT target, kind, count(*) AS n FROM t GROUP BY target, kind",
    "page_paragraphs": f"WITH {_O} SELECT DISTINCT 'page number ' || offer_id || ' of the site' AS paragraph FROM o WHERE kind = 'page'",
    "report_rows": f"""WITH {_CLEAN}, r AS (SELECT netloc, CASE WHEN category IN ('broken_resource', 'unverified_resource') THEN {_DISPLAY.format('category', 'NULL')} || ' (' || coalesce(kind, '') || ')' ELSE {_DISPLAY.format('category', 'category')} END AS category,
  CASE WHEN category IN ('secret', 'secret_info') THEN coalesce(kind, '') || ': ' || coalesce(detail, '') ELSE coalesce(detail, '') END AS detail, coalesce(url, '') AS url, CASE WHEN category IN ('secret', 'secret_info', 'scan_caveat') THEN '' ELSE coalesce(found_on, '') END AS found_on FROM f
  UNION ALL SELECT netloc, 'Missing Security Header', unnest(regexp_extract_all(missing_headers, '"([^"]*)"', 1)), coalesce(header_checked_url, ''), '' FROM site_stats WHERE json_valid(missing_headers))
SELECT netloc, category, {_SEVERITY} AS severity, detail, url, found_on FROM r""",
    "resource_status_class": f"WITH {_RESOURCES} SELECT category, kind, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL",
    "resource_check_findings": f"""WITH {_RESOURCES}, g AS (SELECT netloc, category FROM c WHERE category IS NOT NULL
  UNION ALL SELECT netloc, 'legacy_file' FROM c WHERE fine AND {_ends_any('path', rules.LEGACY_EXTENSIONS)}
  UNION ALL SELECT netloc, 'sensitive_file' FROM c WHERE fine AND ({_ends_any('path', rules.HIGH_SENSITIVE_EXTENSIONS)} OR ({_ends_any('path', rules.CONTEXT_SENSITIVE_EXTENSIONS)} AND regexp_replace(name, '\\.[^.]*$', '') NOT IN ({_in(rules.BENIGN_STEMS)}) AND {_like_any('name', rules.DUMPY_HINTS)})))
SELECT netloc, category, count(*) AS n FROM g GROUP BY ALL""",
    "security_header_stats": f"WITH {_O} SELECT {_SITE} AS netloc, min(url) AS header_checked_url, '{_LACKING}' AS missing_headers FROM o WHERE kind = 'page' AND depth = 0 AND offer_id % 31 <> 0 AND {_STATUS.format('offer_id')} < 400 GROUP BY 1",
    "robots_longest_match": f"WITH {_O}, p AS (SELECT offer_id, {_SLASH} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS p FROM o) SELECT offer_id, CASE WHEN ends_with(p, '.php') THEN false WHEN contains(p, '-a') THEN true ELSE NOT contains(p, 'a') END AS allowed FROM p",
    "find_dedupe_key": rf"WITH k AS (SELECT find_id, kind || chr(0) || CASE WHEN kind = 'humans_txt' THEN lower(domain) ELSE substr(lower({_COLLAPSE.format('text')}), 1, 300) END AS key FROM finds WHERE text IS NOT NULL AND kind IS NOT NULL) SELECT min(find_id) AS find_id, sha1(key) AS key FROM k GROUP BY k.key",
    "body_signatures": rf"""WITH u AS (SELECT doc_id, lower(text) AS t, lower({_PATH}) AS p FROM documents WHERE text IS NOT NULL AND url IS NOT NULL), a AS (SELECT doc_id, CASE WHEN length(p) >= 3 THEN replace(t, p, '') ELSE t END AS t, list_last(string_split(p, '/')) AS l FROM u),
b AS (SELECT doc_id, CASE WHEN length(l) >= 3 THEN replace(t, l, '') ELSE t END AS t FROM a) SELECT sha1(substr({_COLLAPSE.format('t')}, 1, 20000)) AS signature, count(*) AS n, min(doc_id) AS first_doc FROM b GROUP BY 1""",
    "run_totals": f"WITH f AS (SELECT {_NET} AS netloc, count(*) AS n FROM findings WHERE netloc IS NOT NULL GROUP BY 1), s AS (SELECT {_NET} AS netloc, pages_crawled, robots_blocked FROM site_stats) SELECT count(*) AS sites, CAST(sum(coalesce(pages_crawled, 0)) AS BIGINT) AS pages, CAST(sum(coalesce(robots_blocked, 0)) AS BIGINT) AS blocked, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings FROM s FULL JOIN f USING (netloc)",
}
