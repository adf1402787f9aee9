"""DuckDB SQL of the training-data queries that SQL expresses."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d)),
r AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (r.k IS NOT NULL AND l.doc_id <> r.top) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (r.k IS NULL OR l.doc_id = r.top), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k GROUP BY l.doc_id"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p
        FROM g JOIN twice USING (doc_id, s)) GROUP BY doc_id),
q AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars > 40 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > word_chars
            OR (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)
            OR 10 * length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 4 * word_chars
            OR 20 * (length(t) - length(regexp_replace(t, '[{{}}\\\[\];=]', '', 'g'))) > word_chars) AS kept FROM b"""

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_TERM}) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_FOLD}, {_TERM}) AS w FROM benchmark),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM b)),
ms AS (SELECT DISTINCT m FROM b),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
          FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM grams JOIN win USING (m, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit)
        GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

# CRC-32 of the decimal conv_id, bit by bit; the polynomial is a fixed value.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])),
  lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

PREFIX_TRIE = f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {_CRC} % 6 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(p.ts[1:h], []), h.ts[h + 1:]) AS ts
      FROM h LEFT JOIN o AS p ON p.conv_id = h.conv_id - h.conv_id % 100),
n AS (SELECT conv_id, d, md5(CAST(ts[1:d] AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(ts[1:d - 1] AS VARCHAR)) END AS up,
             d = len(ts) AS ends, CASE WHEN d > 0 THEN length(ts[d].t) ELSE 0 END AS size, [md5(CAST(ts[1:x] AS VARCHAR)) FOR x IN range(d + 1)] AS path
      FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM b)),
g AS (SELECT k, d, any_value(up) AS up, any_value(path) AS path, any_value(size) AS size, min(conv_id) AS c, count(*) AS n,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM n GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY up, d),
t AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN kids USING (k, d)),
s AS (SELECT a AS k, i AS d, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * size) AS saved
      FROM (SELECT kids, n, size, unnest(path) AS a, unnest(range(d + 1)) AS i FROM t) GROUP BY a, i)
SELECT t.c AS conv_id, t.d AS depth, p.c AS parent_conv_id, t.n AS n_convs, t.kids AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, t.e AS ends_sha256
FROM t JOIN s USING (k, d) LEFT JOIN g AS p ON p.k = t.up AND p.d = t.d - 1"""

ORACLE = {"op13_prefix_trie": PREFIX_TRIE, "op7_line_dedup": LINE_DEDUP, "op8_quality_rules": QUALITY, "op9_decontamination": DECONTAMINATION,
          "op10_near_dedup": NEAR_DEDUP}
