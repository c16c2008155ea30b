"""DuckDB SQL for the queries that SQL can express, on whole tables."""

from __future__ import annotations

#: Lower-cased words of a text; null has none.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, s, s + least(10, len(w)) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
ds AS (SELECT doc_id, size, s, list_slice(w, s, s + size - 1) AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw CROSS JOIN (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
m AS (SELECT doc_id, s, ds.size, item_id FROM ds JOIN iw ON iw.win = ds.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
#: Bytes are pairs of hexadecimal digits; a window is named by its MD5.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, md5(substring(x, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS s FROM d WHERE length(x) >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM w SEMI JOIN again USING (k)),
g AS (SELECT doc_id, s, sum(CAST(coalesce(gap > 200, true) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, run),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string([substring(x, 2 * p[1] + 1, 2 * (p[2] - p[1])) FOR p IN list_transform(range(0, len(a) + 1), lambda i: [CASE WHEN i = 0 THEN 0 ELSE b[i] END, CASE WHEN i = len(a) THEN length(x) // 2 ELSE a[i + 1] END])], '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""
#: Dense over kept terms and groups: every group's p of every kept term of its language.
DIVERGENCES = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // CAST(total + terms AS HUGEINT) AS BIGINT) AS p FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 1) // CAST(total + terms AS HUGEINT) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200"""
QUALITY_RULES = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
e AS (SELECT k, p AS s, x, lag(x) OVER q AS x0, lead(x) OVER q AS x1, lead(x, 2) OVER q AS x2, lead(x, 3) OVER q AS x3, lead(x, 4) OVER q AS x4 FROM u WINDOW q AS (PARTITION BY k ORDER BY p)),
g AS (SELECT k, s, concat_ws(' ', x, x1, x2, x3, x4) AS win FROM e WHERE x4 IS NOT NULL),
m AS (SELECT k, count(*) FILTER (x = x0) AS n_echoes, count(*) FILTER (regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS n_lettered FROM e GROUP BY k),
again AS (SELECT k, win FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(s, s + 5)) AS p FROM g SEMI JOIN again USING (k, win)) GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
c AS (SELECT k, doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS n_upper FROM d),
a AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
coalesce(n_lines, 0) AS n_lines, n_upper, coalesce(n_echoes, 0) AS n_echoes, coalesce(n_lettered, 0) AS n_lettered FROM c LEFT JOIN r USING (k) LEFT JOIN l USING (k) LEFT JOIN m USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 2 * n_dup_lines > n_lines OR 100 * n_echoes > 40 * n_words OR 100 * n_lettered < 40 * n_words) AS kept FROM a"""
