"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op8() -> str:
    # the twin's own list, which must equal the operator's
    listed = (
        'all rights reserved',
        'terms of use',
        'terms of service',
        'privacy policy',
        'cookie policy',
        'use cookies',
        'enable javascript',
        'sign up for our newsletter',
        'skip to content',
        'licensed under the',
        'spdx-license-identifier',
    )
    phrases = " OR ".join(f"contains(lower(line), {_quoted(p)})" for p in listed)
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
m AS (SELECT doc_id, line, length(line) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS bare, length(regexp_replace(line, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(line, '\P{{Lu}}+', '', 'g')) AS capitals,
 length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, (length(line) - length(replace(line, '!!', ''))) // 2 AS bangs,
 len(list_filter(list_slice(string_split_regex(line, '[ \x09\x0B-\x0D]'), 2, -2), lambda x: x IN ('|', '>', '»', '·'))) AS seps FROM l),
b AS (SELECT doc_id, line, bare, bare > 0 AND (seps >= 2 OR (symbols > 0 AND symbols > 0.1 * bare) OR bangs >= 3
 OR (regexp_matches(line, '\p{{Lu}}{{2}}') AND letters > 24 AND capitals > 0.6 * letters) OR {phrases}) AS broken FROM m),
s AS (SELECT doc_id, CAST(sum(CASE WHEN broken THEN bare ELSE 0 END) AS BIGINT) AS lost, count(*) FILTER (bare > 0) - count(DISTINCT line) FILTER (bare > 0) AS dup FROM b GROUP BY 1),
o AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, lost FROM w JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 * word_chars AS kept FROM f"""


def op9() -> str:
    # the twin's own patterns: kind, pattern, group, least length of it
    kinds = (
        ('assign', '((?i:password|passwd|secret|token|api_?key))["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)', 2, 6),
        ('access', 'AKIA[A-Z0-9]+', 0, 20),
        ('hex', '[0-9a-f]{24,}', 0, 24),
        ('pem', '-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----(?:\\r?\\n[A-Za-z0-9+/=]{40,})*(?:(?:\\r?\\n[A-Za-z0-9+/=]{1,76})?\\r?\\n-----END\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----)?', 0, 1),
        ('forge', 'ghp_[A-Za-z0-9]{36,}', 0, 1),
        ('chat', 'xoxb-[A-Za-z0-9-]{10,}', 0, 1),
        ('web', 'eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+', 0, 1),
    )
    parts = []
    for rank, (kind, pattern, group, _) in enumerate(kinds):
        parts.append(rf"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, i, length(m0[i]) AS n, length(m2[i]) AS k, length(gaps[i]) AS gap FROM (SELECT doc_id, m0, m2, gaps, unnest(range(1, len(m0) + 1)) AS i
 FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS m0, regexp_extract_all(text, {_quoted(pattern)}, {group}) AS m2, string_split_regex(text, {_quoted(pattern)}) AS gaps FROM documents WHERE regexp_matches(text, {_quoted(pattern)})))""")
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, _, _, n in kinds)
    base = ", ".join(f"'{kind}'" for kind in ("assign", "access", "hex"))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("assign", "access", "hex"))
    return f"""WITH m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
k AS (SELECT doc_id, kind, rank, e - n AS s, kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM p WHERE k >= CASE kind {least} END)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""


def op6() -> str:
    def shrink(name: str, rows: str, key: str, parent: str, m: str) -> str:
        """One level: prior strength from moments, then posterior means."""
        return f"""{name}j AS (SELECT c.*, {m} AS m FROM {rows} c {parent}),
{name}r AS (SELECT sum(n * (failing / CAST(n AS DOUBLE) - m) * (failing / CAST(n AS DOUBLE) - m) - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM {name}j),
{name} AS (SELECT j.*, p AS prior, (failing + p * m) / (n + p) AS mean FROM {name}j j, (SELECT CASE WHEN coalesce(rho, 0) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, (1 - rho) / rho)) END AS p FROM {name}r) q)"""

    rules = """WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'"""
    verdicts = "WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'"
    return rf"""WITH pg AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
lb AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS failing FROM labels GROUP BY 1),
hb AS (SELECT page_id, host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM pg WHERE host <> ''),
hl AS (SELECT page_id, host, l, CASE WHEN len(l) = 4 AND array_to_string(list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '1' ELSE '0' END), '') = '1111' THEN 4
 WHEN len(l) > 1 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'go', 'mil', 'ne', 'net', 'nom', 'or', 'org') AND regexp_full_match(l[-1], '[a-z]{{2}}') THEN 3 ELSE 2 END AS k FROM hb),
hd AS (SELECT page_id, host, k, list_slice(l, greatest(1, len(l) - k + 1), len(l)) AS d FROM hl),
hc AS (SELECT host, array_to_string(d, '.') AS domain, array_to_string(CASE WHEN k = 4 OR len(d) = 1 THEN d ELSE d[2:] END, '.') AS suffix, count(failing) AS n, CAST(coalesce(sum(failing), 0) AS BIGINT) AS failing FROM hd LEFT JOIN lb USING (page_id) GROUP BY 1, 2, 3),
sn AS (SELECT * FROM hc WHERE n > 0), sg AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(failing) AS BIGINT) AS failing FROM sn GROUP BY 1), dg AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(failing) AS BIGINT) AS failing FROM sn GROUP BY 1, 2),
{shrink("su", "sg", "suffix", "", "(SELECT (sum(failing) + 0.5) / CAST(sum(n) + 1 AS DOUBLE) FROM sg)")},
{shrink("dm", "dg", "domain", "JOIN su ON su.suffix = c.suffix", "su.mean")},
{shrink("ho", "sn", "host", "JOIN dm ON dm.domain = c.domain", "dm.mean")},
pr AS (SELECT coalesce(max(prior), 1000.0) AS k FROM ho),
ab AS (SELECT host, hc.failing + k * coalesce(dm.mean, su.mean, (SELECT max(m) FROM su), 0) AS a, hc.n - hc.failing + k * (1 - coalesce(dm.mean, su.mean, (SELECT max(m) FROM su), 0)) AS b FROM hc LEFT JOIN dm ON dm.domain = hc.domain LEFT JOIN su ON su.suffix = hc.suffix, pr),
bad AS (SELECT host FROM (SELECT host, a / (a + b) AS m, a + b AS n FROM ab) w WHERE (m + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(m * (1 - m) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n) > 0.25),
ru AS (SELECT *, CASE {rules} END AS rule FROM pg)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM ru"""


def op11() -> str:
    """Each document meets each order and step; nothing is packed."""
    names = "', '".join("ABCDE")
    return rf"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
 regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT d.part, [d.a, d.b, d.c, d.d, d.e] AS f, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, count(*) AS n FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['{names}']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, step, list_transform(range(1, step), lambda j: ascii(filter_order[j]) - 64) AS before, ascii(filter_order[step]) - 64 AS here FROM o, (SELECT unnest(range(1, 6)) AS step) s),
v AS (SELECT part, filter_order, step, here, n, good, toxic, f[here] AS fails, list_bool_or(list_transform(before, lambda j: f[j])) IS TRUE AS gone, len(list_filter(f, lambda y: y)) = 1 AS alone FROM m, k),
g AS (SELECT part, filter_order, step, here, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
 coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost FROM v GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_reputation": op6(), "op8_quality_rules": op8(), "op9_secret_scan": op9(), "op11_filter_audit": op11()}
