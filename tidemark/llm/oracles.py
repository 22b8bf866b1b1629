"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .lines import FUZZY_WORDS, MIN_WORDS, PARTNER_WORDS

FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
BLANK = r"\x20\x09-\x0D"
WORDS = rf"[^{BLANK}]+"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    best = "FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) ORDER BY length(h || q) DESC, length(h) DESC LIMIT 1"
    return f"""WITH rules(h, q, v) AS (VALUES {values}),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages)
SELECT page_id, host, path, (SELECT h || q {best}) AS rule, coalesce((SELECT v {best}), 'allow') AS verdict FROM p"""


NGRAM_JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORDS}') AS w FROM documents),
x AS (SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(n - 1, 2))) AS i FROM x)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS o FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o),
t AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(t.o, d.doc_id) AS component_id FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM k"""

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = rf"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({FOLDED}, '{ITEM_WORD}') AS w FROM benchmark),
y AS (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, m, w[k : k + m - 1] AS g FROM (SELECT item, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM y)),
d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{ITEM_WORD}') AS w FROM documents),
z AS (SELECT doc_id, m, k, w[k : k + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM v))),
h AS (SELECT z.doc_id, z.k, z.m, v.item FROM z JOIN v ON z.m = v.m AND z.g = v.g),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k : k + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 3)) AS q FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{BLANK}]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS cap, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS let
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * cap > let THEN 32 ELSE 0 END AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed, failed & 3 = 0 AS kept_v1 FROM f"""

LINE_DEDUP = rf"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) AS ln FROM s),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[{BLANK}]+'), lambda x: x <> '') AS w, CAST(doc_id AS HUGEINT) * 10000000 + ln AS place FROM b),
d AS (SELECT w, len(w) AS n, min(place) AS p FROM w WHERE len(w) >= {MIN_WORDS} GROUP BY w),
v AS (SELECT w, p, i, list_concat(w[1 : i - 1], w[i + 1 :]) AS g FROM (SELECT w, p, unnest(range(1, n + 1)) AS i FROM d WHERE n >= {FUZZY_WORDS})),
near AS (SELECT w FROM (SELECT w, p, min(p) OVER (PARTITION BY g, i) AS q FROM v) WHERE q < p
  UNION SELECT v.w FROM v JOIN d ON v.g = d.w AND d.n >= {PARTNER_WORDS} WHERE d.p < v.p
  UNION SELECT d.w FROM v JOIN d ON v.g = d.w AND d.n >= {FUZZY_WORDS} WHERE v.p < d.p),
k AS (SELECT x.doc_id, x.ln, x.body, len(x.w) >= {MIN_WORDS} AND (x.place <> d.p OR near.w IS NOT NULL) AS gone FROM w x LEFT JOIN d ON x.w = d.w LEFT JOIN near ON x.w = near.w),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(body, chr(10) ORDER BY ln) FILTER (WHERE NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_removed, 0) AS n_removed, length(t.text) AS n_chars, sha256(t.text) AS text_sha256 FROM documents o LEFT JOIN t USING (doc_id)"""
