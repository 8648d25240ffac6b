"""SQL with the same rows as some of the operators' queries, written independently of how they work."""

from __future__ import annotations

from . import license_scan


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


OP2_SQL = rf"""
WITH known(id, sentence) AS (VALUES {_values([*license_scan.SENTENCES.items(), *((i, s) for s, i in license_scan.VARIANTS.items())])}),
rule(nth, rule, licence, ids) AS (VALUES {_values([(i, r, x, "," + f"(,[^,]+){{0,{license_scan.GAP}}},".join(y.replace(".", "[.]") for y in w) + ",") for i, (r, x, w) in enumerate(license_scan.RULES)])}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;:]([ \t\r\n])', chr(10) || '\1', 'g'), '[.!?;:]$', '') AS t FROM documents),
s AS (SELECT rid, unnest(a) AS sentence, generate_subscripts(a, 1) AS i FROM (SELECT rid, string_split(t, chr(10)) AS a FROM d)),
hit AS (SELECT rid, i, id FROM (SELECT rid, i, trim(regexp_replace(sentence, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM s) JOIN known USING (sentence)),
seq AS (SELECT rid, count(*) AS n_sentences, string_agg(id, ',' ORDER BY i) AS ids FROM hit GROUP BY rid),
fit AS (SELECT rid, licence, arg_min(rule, nth) AS rule FROM seq JOIN rule ON regexp_matches(',' || seq.ids || ',', rule.ids) GROUP BY 1, 2),
lic AS (SELECT rid, string_agg(licence, ',' ORDER BY licence) AS licenses, string_agg(rule, ',' ORDER BY licence) AS rules FROM fit GROUP BY 1)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(rules, '') AS rules
FROM d LEFT JOIN seq USING (rid) LEFT JOIN lic USING (rid)
"""

#: For pages laid out as the given ones are: one article element, with h1 and p as its only blocks.
OP6_SQL = r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS a FROM pages),
t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(a, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'),
    '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

#: Exact: all pairs that share a shingle, and components of those that reach the threshold.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
sh AS (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s, count(*) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) GROUP BY 1, 2),
size AS (SELECT doc_id, sum(n) AS n FROM sh GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE pair.n / (p.n + q.n - pair.n) >= 0.8),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
class AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, doc_id <= coalesce(m, doc_id) AS is_first FROM documents LEFT JOIN class ON a = doc_id
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, CAST((5 * i) // 4 + 1 AS BIGINT), 2) AS BIGINT) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""

#: CRC-32 by its table of 256 entries, which is made by rule; near words by their deletions: one is a deletion of the other, or both have one at the same place.
OP11_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
    CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 | (ord(x) >> 6) AS BIGINT), CAST(128 | (ord(x) & 63) AS BIGINT)] END))),
    lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM d, crc),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE n >= 5 AND length(word) >= 6),
x AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS word, b.word AS other FROM x a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM x a JOIN v b ON a.cut = b.word
  UNION SELECT a.word, b.word FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS cur, 0 AS k FROM f UNION ALL SELECT up.word, f.form, k + 1 FROM up JOIN f ON f.word = up.cur WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(cur, k) AS root FROM up GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM f JOIN root USING (word)
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
n AS (SELECT rid, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
s AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS terms FROM n),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
q AS (SELECT qid, item_id, unnest(list_distinct(ws)) AS term FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS ws FROM benchmark WHERE text IS NOT NULL)),
r AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (rid), s GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, rid)
"""
