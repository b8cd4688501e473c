"""DuckDB forms of the queries that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SUFFIX = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 200)) AS k FROM h, unnest(range(greatest(n - 99, 0))) u(i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
b AS (SELECT h.doc_id, u.i, substr(hx, 2 * u.i + 1, 2) AS b, m.i AS start FROM h, unnest(range(n)) u(i) LEFT JOIN m ON m.doc_id = h.doc_id AND m.i = u.i),
c AS (SELECT doc_id, i, b, max(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(CASE WHEN NOT gone THEN b END, '' ORDER BY i), '') AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN a ON a.doc_id = h.doc_id
"""

# The letters of the first kind in either case, written out.
_ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() and c.isascii() else c for c in "(password|passwd|secret|token|api_?key)")
_KINDS = [
    ("assign", _ASSIGN + r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", f"""length(regexp_replace(m, '^{_ASSIGN}["'']?\\x20*[:=]\\x20*["'']?', '')) >= 8"""),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]{32,}", "true"),
    ("pem", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, text, {k} AS rank, '{name}' AS kind, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE text IS NOT NULL" for k, (name, pattern, _) in enumerate(_KINDS))
_FITS = " ".join(f"WHEN '{name}' THEN {fits}" for name, _, fits in _KINDS)

# The next match of a pattern is the next occurrence of its text, as an earlier one would have matched before.
SECRETS = f"""
WITH RECURSIVE f AS (SELECT * FROM ({_FOUND}) WHERE len(ms) > 0),
r AS (
  SELECT doc_id, rank, kind, ms, text, 0 AS k, 0::BIGINT AS start, 0::BIGINT AS stop FROM f
  UNION ALL
  SELECT doc_id, rank, kind, ms, text, k + 1, stop + strpos(substr(text, stop + 1), ms[k + 1]) - 1, stop + strpos(substr(text, stop + 1), ms[k + 1]) - 1 + length(ms[k + 1]) FROM r WHERE k < len(ms)
),
s AS (SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || stop AS span FROM (SELECT *, ms[k] AS m FROM r WHERE k > 0) WHERE CASE kind {_FITS} END),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '') AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM w, unnest(range(1, len(ws) - 1)) u(i) WHERE len(ws) >= 3
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

# For pages whose article is an element of that name with paragraphs, headings and lists, as in the test tables.
_DECODED = "regexp_replace(replace(replace(replace(replace(x, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g')"
MAIN_TEXT = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, string_split_regex(replace(regexp_replace(a, '</?b>', '', 'g'), '<br>', ' '), '</?(p|h1|ul|li)>') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b),
t AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

_PARTS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# r holds, step by step, the pairs of equal words that no tile covers yet; a tile is the longest run along a diagonal, the first in
# the item, then in the text.
TILES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PARTS} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, ws, len(ws) AS n, least(5, len(ws)) AS least FROM (SELECT item_id, {_PARTS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(ws) > 0),
ig AS (SELECT DISTINCT item_id, least, array_to_string(ws[k:k + least - 1], ' ') AS g FROM i, unnest(range(1, n - least + 2)) u(k)),
dg AS (SELECT DISTINCT doc_id, s.least, array_to_string(ws[k:k + s.least - 1], ' ') AS g FROM d, (SELECT DISTINCT least FROM i) s, unnest(range(1, len(ws) - s.least + 2)) u(k)),
p AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.least = ig.least),
iw AS (SELECT item_id, least, k AS a, ws[k] AS w FROM i, unnest(range(1, n + 1)) u(k)),
dw AS (SELECT doc_id, k AS b, ws[k] AS w FROM d, unnest(range(1, len(ws) + 1)) u(k) WHERE doc_id IN (SELECT doc_id FROM p)),
r AS (
  SELECT 0 AS step, p.doc_id, p.item_id, iw.least, a, b FROM p JOIN iw ON iw.item_id = p.item_id JOIN dw ON dw.doc_id = p.doc_id AND dw.w = iw.w
  UNION ALL
  SELECT step + 1, doc_id, item_id, least, a, b FROM (
    SELECT *, max({{'n': n, 'a': -a0, 'b': -b0}}) OVER (PARTITION BY doc_id, item_id) AS t FROM (
      SELECT *, count(*) OVER g AS n, min(a) OVER g AS a0, min(b) OVER g AS b0 FROM (
        SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, b - a ORDER BY a) AS run FROM r)
      WINDOW g AS (PARTITION BY doc_id, item_id, b - a, run)))
  WHERE t.n >= least AND NOT (a >= -t.a AND a < -t.a + t.n) AND NOT (b >= -t.b AND b < -t.b + t.n)
),
best AS (
  SELECT step, doc_id, item_id, least, max(n) AS n FROM (
    SELECT *, count(*) OVER (PARTITION BY step, doc_id, item_id, b - a, run) AS n FROM (
      SELECT *, a - row_number() OVER (PARTITION BY step, doc_id, item_id, b - a ORDER BY a) AS run FROM r)) GROUP BY step, doc_id, item_id, least)
SELECT doc_id, best.item_id, i.n::BIGINT AS n_words, sum(best.n)::BIGINT AS n_covered, count(*)::BIGINT AS n_tiles, round(sum(best.n) / i.n, 6) AS coverage
FROM best JOIN i ON i.item_id = best.item_id WHERE best.n >= best.least GROUP BY doc_id, best.item_id, i.n HAVING 2 * sum(best.n) >= i.n
"""
