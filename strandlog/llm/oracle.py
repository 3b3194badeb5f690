"""DuckDB twins of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

#: Exact Jaccard on sets of two-word shingles, and the components of the links.
NEAR = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS s FROM cut),
class AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
one AS (SELECT c, n, unnest(s) AS x FROM class),
link AS (SELECT a.c AS a, b.c AS b FROM one a JOIN one b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c, c AS to_c FROM class UNION SELECT r.c, e.b FROM reach r JOIN edge e ON e.a = r.to_c),
component AS (SELECT c, min(to_c) AS least FROM reach GROUP BY c)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, d.doc_id = coalesce(m.least, d.doc_id) AS kept
FROM sets d LEFT JOIN class k ON k.s = d.s LEFT JOIN component m ON m.c = k.c"""

#: Digests of the turns as they are; the formatted length counts a star for every mark of a text that must be escaped.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok', r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, r)),
sized AS (
  SELECT *, 24 + length(role) + 2 * len(regexp_extract_all(role, '[%\n<|]')) + length(text)
    + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\*+\|') THEN len(regexp_extract_all(text, '<\**\|')) ELSE 0 END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

#: Shares of every kept term in every group, and their differences by all pairs of groups.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(d) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
share AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cell),
whole AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL),
base AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
term AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - b.q AS value FROM share s JOIN base b ON b.lang = s.lang AND b.term = s.term WHERE s.n > 0 AND s.p > b.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

#: Every url with every rule.
URLS = r"""
WITH rule(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
host AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM cut),
page AS (SELECT page_id, r, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM host)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule.h || rule.p, length(rule.h || rule.p)) AS rule, coalesce(arg_max(rule.v, length(rule.h || rule.p)), 'allow') AS verdict
FROM page LEFT JOIN rule ON (page.host = rule.h OR ends_with(page.host, '.' || rule.h)) AND starts_with(page.path, rule.p) GROUP BY page_id, r"""

#: Exact counts of all phrases of up to three words.
COLLOCATIONS = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
cut AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM cut
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM cut WHERE len(w) > 2),
f AS (SELECT lang, m, phrase, count(*) AS n FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY ALL),
much AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
side AS (SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM much, (VALUES (1), (2)) c(k) WHERE k < m),
scored AS (SELECT s.*, x.n AS l, y.n AS r, (1000000 * a::HUGEINT * a) // (x.n::HUGEINT * y.n) AS score FROM side s JOIN f x ON x.lang = s.lang AND x.phrase = s.x AND x.m = s.k JOIN f y ON y.lang = s.lang AND y.phrase = s.y AND y.m = s.m - s.k),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, CASE k WHEN 1 THEN y ELSE x END AS phrase, a FROM side WHERE m = 3) GROUP BY ALL),
best AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT b.lang, rank, phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score FROM best b JOIN total t ON t.lang = b.lang WHERE rank <= 2000"""
