"""SQL of the queries that SQL can state over whole tables."""

from __future__ import annotations

from quarrylight.rules import TRACKING_PARAMS

_TRACKING = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)

P2_FOUND = rf"""
WITH parts AS (
  SELECT offer_id, lower(regexp_replace(urlhash, '^\s+|\s+$', '', 'g')) AS h, url,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s,
         lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS n,
         regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/{{2,}}', '/', 'g') AS p,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q
  FROM frontier),
canon AS (
  SELECT offer_id, h, url,
         s || '://' || CASE WHEN s = 'http' THEN regexp_replace(n, ':80$', '') WHEN s = 'https' THEN regexp_replace(n, ':443$', '') ELSE n END
         || CASE WHEN p = '' THEN '/' ELSE p END AS base,
         array_to_string(list_sort(list_filter(string_split(q, '&'), lambda kv: kv <> '' AND lower(split_part(kv, '=', 1)) NOT IN ({_TRACKING}))), '&') AS kept
  FROM parts),
keys AS (
  SELECT DISTINCT offer_id, CASE WHEN regexp_full_match(h, '[0-9a-f]{{40}}') THEN h
                                 ELSE sha1(base || CASE WHEN kept = '' OR kept IS NULL THEN '' ELSE '?' || kept END) END AS k
  FROM canon)
SELECT DISTINCT a.offer_id FROM keys a JOIN (SELECT k, min(offer_id) AS m FROM keys WHERE k IS NOT NULL GROUP BY k) b ON a.k = b.k WHERE a.offer_id > b.m
"""

_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"

P9_FOUND = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 50),
named AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g, len(words) AS n FROM grams),
later AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS r FROM named),
steps AS (SELECT doc_id, n, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM later WHERE r > 1)
SELECT doc_id FROM steps GROUP BY doc_id HAVING sum(least(coalesce(nxt - i, 5), 5)) * 10 >= 3 * max(n)
"""

_SHINGLES = rf"""
w AS (SELECT find_id, kind, {_WORDS} AS words FROM finds WHERE kind IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT find_id, kind, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS g FROM w WHERE len(words) >= 20),
n AS (SELECT find_id, count(*) AS n FROM s GROUP BY find_id)
"""

P1_FOUND = rf"""
WITH {_SHINGLES},
c AS (SELECT a.find_id AS a, b.find_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.kind = b.kind AND a.find_id < b.find_id GROUP BY 1, 2)
SELECT a AS find_a, b AS find_b FROM c JOIN n x ON x.find_id = a JOIN n y ON y.find_id = b WHERE shared * 100 >= 60 * (x.n + y.n - shared)
"""

P1_GROUPS = rf"""
WITH RECURSIVE w AS (SELECT find_id, kind, {_WORDS} AS words FROM finds WHERE kind IS NOT NULL AND text IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT find_id, kind, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS g FROM w WHERE len(words) >= 5),
n AS MATERIALIZED (SELECT find_id, count(*) AS n FROM s GROUP BY find_id),
c AS MATERIALIZED (SELECT a.find_id AS a, b.find_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.kind = b.kind AND a.find_id < b.find_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.find_id = a JOIN n y ON y.find_id = b WHERE shared * 100 >= 80 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT x.a AS find_id, x.class_id, y.links FROM (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a) x JOIN (SELECT a, count(*) AS links FROM e GROUP BY a) y USING (a)
"""

P7_FOUND = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS words FROM eval_items),
iw AS (SELECT item_id, least(12, len(words)) AS size, words, unnest(range(1, len(words) - least(12, len(words)) + 2)) AS k FROM i WHERE len(words) > 0),
ig AS (SELECT DISTINCT item_id, size, array_to_string(words[k:k + size - 1], ' ') AS g FROM iw),
sizes AS (SELECT DISTINCT size FROM ig),
d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS k FROM d, sizes WHERE len(words) >= size),
dg AS (SELECT doc_id, size, array_to_string(words[k:k + size - 1], ' ') AS g FROM dw)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (size, g)
"""

SQL = {"p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p2_found": P2_FOUND, "p7_found": P7_FOUND, "p9_found": P9_FOUND}
