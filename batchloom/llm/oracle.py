"""The results of corpus queries in DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from batchloom.llm import lines, secret_scan, suffix

WORD = r"[^ \t\n\v\f\r]+"

# Strings of bytes as pairs of hexadecimal digits; of equal ones, all but the first are repeats.
OP4 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * suffix.LENGTH}) AS s
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {suffix.LENGTH - 1})) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix.LENGTH} THEN 0 ELSE 1 END AS b FROM r),
g AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + {suffix.LENGTH} AS z FROM g GROUP BY doc_id, g.g),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS gone, max(z) AS z,
             string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * z + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

# Five hexadecimal digits are four digits in base 32.
OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(d, 5 * i + 1, 5))::BIGINT) AS v FROM q)
SELECT page_id, CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, n AS payload_bytes,
       array_to_string(list_transform(flatten(list_transform(v, lambda x: [x // 32768, x // 1024, x // 32, x])),
           lambda y: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', y % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > f THEN f END AS refers_to FROM v"""


def _matches(rank: int, rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {rank} AS k, len(f[i]) AS size, len(g[i]) AS tested,
       list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) AS a
FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS f,
             regexp_extract_all(t, '{pattern}', {rule.group}) AS g, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i
      FROM d WHERE regexp_matches(t, '{pattern}')) WHERE len(g[i]) >= {rule.least}"""


_KINDS = [r.kind for r in secret_scan.BASE_RULES]
OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(secret_scan.RULES))}),
x AS (SELECT doc_id, kind, a, k, kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS x FROM m),
c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)},
             coalesce(string_agg(x, ',' ORDER BY a, k) FILTER (k < {len(_KINDS)}), '') AS b, string_agg(x, ',' ORDER BY a, k) AS spans
      FROM x GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _KINDS)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)"""

OP10 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM d),
e AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
f AS (SELECT r, i FROM e QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY r),
l AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}')),
u AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM l GROUP BY r),
z AS (SELECT r, len(regexp_extract_all(x, '{WORD}')) AS n,
             trim(regexp_replace(lower(x), '[ \t\n\v\f\r]+', ' ', 'g')) AS x FROM l),
s AS (SELECT host, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS n_host FROM d GROUP BY host),
h AS (SELECT host, x FROM z JOIN d USING (r) JOIN s USING (host) GROUP BY host, x, n_host
      HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) > 5 AND 100 * count(DISTINCT coalesce(doc_id::VARCHAR, '')) > 5 * n_host),
o AS (SELECT r, sum(n) AS n FROM z JOIN d USING (r) JOIN h USING (host, x) GROUP BY r),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(o.n, 0)::BIGINT AS n_removed_words
      FROM d JOIN w USING (r) LEFT JOIN u USING (r) LEFT JOIN c USING (r) LEFT JOIN o USING (r)),
b AS (SELECT *, n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {lines.MIN_KEPT} * n_words AS kept FROM b"""

# Every document, order and step; a filter of position p in an order removes what fails none before it.
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT r, doc_id, part, unnest([{{'f': 'A', 'x': len(ws) < 200}}, {{'f': 'B', 'x': 100 * len(list_distinct(ws)) < 50 * len(ws)}},
             {{'f': 'C', 'x': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * len(t)}}, {{'f': 'D', 'x': regexp_matches(t, '[#$%&*|]')}},
             {{'f': 'E', 'x': coalesce(first < doc_id, false)}}], recursive := true) FROM w),
s AS (SELECT r, part, any_value(doc_id) AS doc_id, coalesce(string_agg(f, '' ORDER BY f) FILTER (x), '') AS fails FROM f GROUP BY r, part),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM s LEFT JOIN l USING (doc_id) GROUP BY part, fails),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT o, i, substr(o, i, 1) AS x, substr(o, 1, i - 1) AS done FROM o, unnest(range(1, 6)) AS u(i)),
v AS (SELECT part, o, i, x, n, good, bad, contains(fails, x) AS bad_here, fails = x AS only_here,
             len(done) > 0 AND regexp_matches(fails, '[' || done || '0]') AS gone FROM m, p),
g AS (SELECT part, o AS filter_order, i::INTEGER AS step, x, coalesce(sum(n) FILTER (NOT bad_here AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (bad_here AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bad_here AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (only_here), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (bad_here AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(bad) FILTER (bad_here AND NOT gone), 0)::BIGINT AS toxic_lost FROM v GROUP BY part, o, i, x)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{TERM}') AS ws FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*) FILTER (len(ws) > 0) AS n_all, sum(len(ws))::BIGINT AS l_all FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, doc_id, n, w, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY r, doc_id, n, w),
f AS (SELECT w, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, n GROUP BY w, n_all),
i AS (SELECT r, doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l_all))) AS x FROM p JOIN f USING (w), n),
s AS (SELECT item_id, r, doc_id, sum(x)::BIGINT AS score FROM q JOIN i USING (w) GROUP BY item_id, r, doc_id HAVING sum(x) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s
QUALIFY rank <= 10"""

ORACLE = {"op4_suffix": OP4, "op6_warc": OP6, "op7_secrets": OP7, "op10_lines": OP10, "op11_search": OP11, "op12_audit": OP12}
