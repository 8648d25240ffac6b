"""Text functions, structure and search over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry, search, search_index, structure, text, udfs, vector_index, vectors
from ..operators import filters, joins, setops, windows
from ..sources.shared import Scratch, shared_folder
from .registry import SQL, query
from .registry import table as t


def _docs(spark, sf, *cols):
    return t(spark, sf, "documents").select("doc_id", *cols)


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def t1_fold(spark, sf):
    return _docs(spark, sf, text.fold(F.col("text")).alias("folded"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE coalesce(nullif(regexp_extract(substr(text, 1, 81), '(?s)^(.+) [^ ]*$', 1), ''), substr(text, 1, 80)) || '…' END AS cut FROM documents")
def t2_truncate_words(spark, sf):
    return _docs(spark, sf, text.truncate_words(F.col("text"), 80).alias("cut"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents),
a AS (SELECT *, strpos(lower(flat), 'with') - 1 AS hit FROM f),
s AS (SELECT *, CASE WHEN hit < 0 THEN 0 ELSE greatest(0, least(hit - 47, greatest(length(flat) - 140, 0))) END AS start FROM a),
w AS (SELECT *, substr(flat, start + 1, 140) AS win, start + 140 < length(flat) AS more FROM s),
l AS (SELECT *, CASE WHEN start > 0 THEN regexp_replace(win, '^[^ ]* ', '') ELSE win END AS lft FROM w)
SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE '' END || CASE WHEN more THEN regexp_replace(lft, ' [^ ]*$', '') ELSE lft END || CASE WHEN more THEN '…' ELSE '' END AS snippet FROM l""")
def t3_snippet(spark, sf):
    return _docs(spark, sf, text.snippet(F.col("text"), "with").alias("snippet"))


_DIRT = "   \n\n\n\nBack \t to\u00a0top \U0001f517\ufe0f Pagina 3 van 10\n(\n x y \nz) Return to\ntop of page αβγabc \U0001f517"


def _sql_rules(col: str, rules: list[text.Rule]) -> str:
    for pattern, repl in rules:
        back = repl.replace("$1", r"\1").replace("$2", r"\2")
        col = f"regexp_replace({col}, '{pattern}', '{back}', 'g')"
    return col


def _sql_trim(col: str) -> str:
    return f"regexp_replace({col}, '^{text.SPACE}+|{text.SPACE}+$', '', 'g')"


# The SQL's own rules, written out again, so that a wrong rule of the library shows
_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SQL_LINKS = [(r"\x{1F517}\x{FE0F}?", "")]
_SQL_PAGES = [(rf"(?im)(^|{_WS})pagina{_WS}+\d+{_WS}+van{_WS}+\d+{_WS}*", "$1")]
_SQL_SCRIPTS = [(r"([\x{590}-\x{5FF}\x{370}-\x{3FF}])([a-zA-Z])", "$1 $2"), (r"([a-zA-Z])([\x{590}-\x{5FF}\x{370}-\x{3FF}])", "$1 $2")]
_SQL_DEBRIS = [
    *_SQL_LINKS,
    *[(f"(?i){f'{_WS}+'.join(words.split())}{_WS}*", "") for words in ("return to top of page", "back to top", "top of page")],
    *_SQL_PAGES,
    (rf"\({_WS}*\n{_WS}*([^()\n]{{1,60}}?){_WS}*\n", "($1)\n"),
    *_SQL_SCRIPTS,
    (r"[ \t]+\n", "\n"),
    (r"\n\n\n+", "\n\n"),
]
_SQL_TOP = [(f"(?i){f'{_WS}+'.join('return to top of page'.split())}", "")]


def _sql_trimmed(col: str) -> str:
    return f"regexp_replace({col}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"SELECT doc_id, {_sql_trimmed(_sql_rules(f"text || '{_DIRT}'", _SQL_DEBRIS))} AS clean FROM documents")
def t4_clean_text(spark, sf):
    return _docs(spark, sf, text.clean_text(F.concat("text", F.lit(_DIRT))).alias("clean"))


_FRONT = "Legenda  Blauw: a, b\nc d\nDe titel\nUit het Latijn vertaald\ndoor X, NUR 700\n\nPagina 1 van 9 \U0001f517\ufe0f "


_SQL_COLOPHON = r"(?im)^(?:DE GROOT GOUDRIAAN(?s:.*?)NUR \d+|Ongewijzigde fotografische herdruk(?s:.*?)NUR \d+|Uit het Latijn vertaald(?s:.*?)NUR \d+)\n*"
_SQL_FRONT = f"regexp_replace(regexp_replace('{_FRONT}' || text, '(?m)^Legenda{_WS}+Blauw(?s:.*?)(\n[A-Z][a-z])', '\\1'), '{_SQL_COLOPHON}', '')"


@query(f"SELECT doc_id, {_sql_trimmed(_sql_rules(_SQL_FRONT, [*_SQL_PAGES, (f'{_SQL_LINKS[0][0]}{_WS}*', ''), *_SQL_TOP]))} AS body FROM documents")
def t5_strip_front_matter(spark, sf):
    return _docs(spark, sf, text.strip_front_matter(F.concat(F.lit(_FRONT), "text")).alias("body"))


_MARKED_PARAGRAPH = "' Pagina 3 van 4 αb \U0001f517\ufe0f Return to top of page' || text"


_SQL_PARAGRAPH = [*_SQL_LINKS, *_SQL_TOP, (rf"(?i)(^|{_WS})pagina{_WS}+\d+{_WS}+van{_WS}+\d+({_WS}|$)", "$1$2"), *_SQL_SCRIPTS]


@query(f"SELECT doc_id, {_sql_trimmed(_sql_rules(_MARKED_PARAGRAPH, _SQL_PARAGRAPH))} AS para FROM documents")
def t6_clean_paragraph(spark, sf):
    return _docs(spark, sf, text.clean_paragraph(F.concat(F.lit(" Pagina 3 van 4 αb \U0001f517\ufe0f Return to top of page"), "text")).alias("para"))


_ABBREVIATIONS: list[text.Rule] = [("(^|[^A-Za-zÀ-ÿ])[Rr]e([^A-Za-zÀ-ÿ]|$)", "$1RE$2"), ("(^|[^A-Za-zÀ-ÿ])of ([A-Za-zÀ-ÿ])", "$1OF-$2"), ("([0-9]+)[.]([0-9]+)", "$1:$2")]


@query(f"SELECT doc_id, {_sql_rules('text', _ABBREVIATIONS)} AS expanded FROM documents")
def t7_apply_rules(spark, sf):
    return _docs(spark, sf, text.apply_rules(F.col("text"), _ABBREVIATIONS).alias("expanded"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'Frankrijk' WHEN 'GERMANY' THEN 'Duitsland' ELSE n_name END AS display FROM nation")
def t8_map_value(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", text.map_value(F.col("n_name"), {"FRANCE": "Frankrijk", "GERMANY": "Duitsland"}).alias("display"))


def _ranges(spark, sf):
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("lo"), F.max("l_linenumber").cast("long").alias("m"))
    return li.select("l_orderkey", (F.col("l_orderkey") % 3 + 1).alias("c"), "lo", F.when(F.col("l_orderkey") % 4 == 0, 999).otherwise(F.col("m")).cast("long").alias("hi"))


_RANGES = "(SELECT l_orderkey, l_orderkey % 3 + 1 AS c, min(l_linenumber) AS lo, CASE WHEN l_orderkey % 4 = 0 THEN 999 ELSE max(l_linenumber) END AS hi FROM lineitem GROUP BY 1)"


@query(f"SELECT l_orderkey, CASE WHEN lo = 1 AND hi >= 999 THEN 'Boek ' || c WHEN hi > lo THEN 'Boek ' || c || ':' || lo || '–' || hi ELSE 'Boek ' || c || ':' || lo END AS ref FROM {_RANGES}")
def t9_format_ref(spark, sf):
    return _ranges(spark, sf).select("l_orderkey", text.format_ref(F.lit("Boek"), F.col("c"), F.col("lo"), F.col("hi")).alias("ref"))


@query(f"SELECT l_orderkey, c AS nc, hi + 1 AS ns, hi + hi - lo + 1 AS ne, CASE WHEN lo > 1 OR c <= 1 THEN c ELSE c - 1 END AS pc, CASE WHEN lo > 1 THEN greatest(lo - (hi - lo + 1), 1) WHEN c <= 1 THEN lo ELSE 999 END AS ps, CASE WHEN lo > 1 THEN lo - 1 WHEN c <= 1 THEN hi ELSE 999 END AS pe FROM {_RANGES}")
def t10_shift_ref(spark, sf):
    args = F.col("c"), F.col("lo"), F.col("hi")
    after, before = text.shift_ref(*args, True), text.shift_ref(*args, False)
    return _ranges(spark, sf).select("l_orderkey", *[x.alias(n) for x, n in zip((*after, *before), ("nc", "ns", "ne", "pc", "ps", "pe"), strict=True)])


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN CAST(1500 + c_custkey % 400 AS VARCHAR) END, '?') || '–' || coalesce(CASE WHEN c_custkey % 4 > 0 THEN CAST(1570 + c_custkey % 400 AS VARCHAR) END, '?') AS life FROM customer")
def t11_lifespan(spark, sf):
    year = lambda m, y: F.when(F.col("c_custkey") % m > 0, y + F.col("c_custkey") % 400)
    return t(spark, sf, "customer").select("c_custkey", text.lifespan(year(3, 1500), year(4, 1570)).alias("life"))


@query(r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '. ' || upper(p_name) ELSE 'Index of ' || p_name END, '^\s*\d+[.)]?\s+', '')) AS x FROM part)
SELECT p_partkey, CASE WHEN x ILIKE 'index of %' THEN substr(x, 10) || ' (verwijzingen)' WHEN length(x) > 5 AND x = upper(x) AND x <> lower(x) THEN list_aggregate(list_transform(string_split(lower(x), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') ELSE x END AS title FROM n""")
def t12_norm_title(spark, sf):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.upper("p_name"))).otherwise(F.concat(F.lit("Index of "), "p_name"))
    return t(spark, sf, "part").select("p_partkey", text.norm_title(raw).alias("title"))


@query(r"""WITH l AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS x FROM documents), u AS (SELECT *, x = '' OR regexp_matches(x, '^[\d.\s]+$') OR length(x) > 80 OR regexp_matches(x, '[<>{}|]') AS ugly FROM l)
SELECT doc_id, ugly, ugly OR length(x) < 4 OR (x = upper(x) AND x <> lower(x)) AS strict FROM u""")
def t13_ugly_title(spark, sf):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return _docs(spark, sf, text.is_ugly_title(first).alias("ugly"), text.is_ugly_title(first, True).alias("strict"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, 'Hoofdstuk ' || doc_id || CASE WHEN x = '' THEN '' ELSE ': ' || CASE WHEN length(x) <= 55 THEN x ELSE coalesce(nullif(regexp_extract(substr(x, 1, 55), '^(.{30,}) [^ ]*$', 1), ''), substr(x, 1, 55)) || '…' END END AS title FROM f""")
def t14_fallback_title(spark, sf):
    return _docs(spark, sf, text.fallback_title(F.col("text"), F.col("doc_id")).alias("title"))


@query(f"SELECT doc_id, {_sql_rules('text', [*text.CORRECTIONS.values()]).replace('p{L}', 'pL')} AS corrected FROM documents")
def t15_corrections(spark, sf):
    return _docs(spark, sf, text.apply_rules(F.col("text"), [*text.CORRECTIONS.values()]).alias("corrected"))


@query("SELECT doc_id, 'commas' AS rule, substr(text, 1, 120) AS before, substr(replace(text, ', ', ' , '), 1, 120) AS after FROM documents WHERE contains(text, ', ')")
def t16_preview(spark, sf):
    return text.preview_rules(_docs(spark, sf, "text"), "doc_id", "text", (", ", " , "), "commas")


@query(r"SELECT doc_id, length(regexp_replace(text, ' +([,.;:!?])', '\1', 'g')) AS n FROM documents")
def t17_apply_and_count(spark, sf):
    out, _ = text.apply_and_count(_docs(spark, sf, "text"), "text", text.CORRECTIONS["punctuation"])
    return out.select("doc_id", F.length("text").alias("n"))


@query("SELECT doc_id, replace(text, '.', '!') AS literal, regexp_replace(text, 'th(e|a)', 'TH', 'g') AS regex FROM documents")
def t18_replace_text(spark, sf):
    return _docs(spark, sf, text.replace_text(F.col("text"), ".", "!").alias("literal"), text.replace_text(F.col("text"), "th(e|a)", "TH", True).alias("regex"))


_LAST = "([A-Za-zÀ-ÿ]+)ing(?:[^A-Za-zÀ-ÿ]|$)"


@query(f"SELECT doc_id, list_extract(regexp_extract_all(text, '{_LAST}', 1), -1) AS last FROM documents")
def t19_last_match(spark, sf):
    return _docs(spark, sf, text.last_match(F.col("text"), _LAST).alias("last"))


@query("SELECT event_id, greatest(1, least(52, CAST(ceil((floor(epoch(ts)) - epoch(date_trunc('year', ts))) / 604800) AS INTEGER))) AS week, isodow(ts) - 1 AS weekday, dayofyear(ts) AS yearday FROM events")
def t20_t21_t22_dates(spark, sf):
    return t(spark, sf, "events").select("event_id", text.plan_week(F.col("ts")).alias("week"), text.weekday0(F.col("ts")).alias("weekday"), F.dayofyear("ts").alias("yearday"))


@query("SELECT o_orderkey, replace(replace(replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '#'), '.', ','), '#', '.') AS price, strftime(o_orderdate, '%-d-%-m-%Y') AS day FROM orders")
def t23_locale(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", text.format_number_nl(F.floor("o_totalprice")).alias("price"), text.format_date_nl(F.col("o_orderdate")).alias("day"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 > 0 AND (o_orderkey % 900000) / 100.0 BETWEEN 1 AND 5000 THEN CAST((o_orderkey % 900000) / 100.0 AS DECIMAL(10,2)) END AS VARCHAR) AS amount FROM orders")
def t24_parse_amount(spark, sf):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "12x").otherwise(F.concat(F.lit(" "), F.floor((F.col("o_orderkey") % 900000) / 100).cast("string"), F.lit(","), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")))
    return t(spark, sf, "orders").select("o_orderkey", text.parse_amount(raw).cast("string").alias("amount"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS status FROM orders")
def t25_map_status(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "open")
    return t(spark, sf, "orders").select("o_orderkey", text.map_status(raw).alias("status"))


@query("SELECT page_id, replace(replace(url, '&', '~and~'), '~and~', '&') AS decoded, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def t26_urls(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.decode_path(F.replace("url", F.lit("&"), F.lit("~and~"))).alias("decoded"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query(r"SELECT doc_id, length(text) AS n_chars, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS n_words FROM documents")
def t27_lengths(spark, sf):
    return _docs(spark, sf, F.length("text").alias("n_chars"), text.word_count(F.col("text")).alias("n_words"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' ')[1:20])), ' ') AS words, substr(text, 1, 1) AS initial, list_contains(string_split(text, ' '), 'the') AS has_the FROM documents")
def t28_arrays(spark, sf):
    w = F.split("text", " ")
    return _docs(spark, sf, F.array_join(F.sort_array(F.array_distinct(F.slice(w, 1, 20))), " ").alias("words"), F.substring("text", 1, 1).alias("initial"), F.array_contains(w, "the").alias("has_the"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'OT' ELSE 'NT' END AS testament FROM part")
def t29_in_set(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.when(filters.in_list(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13"]), "OT").otherwise("NT").alias("testament"))


@query("SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn, text) AS notes FROM conversations GROUP BY 1")
def t30_concat_notes(spark, sf):
    return text.concat_notes(t(spark, sf, "conversations"), "conv_id", "turn", "text")


# structure


def _aliases(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.lower(F.substring("n_name", 1, 4)).alias("alias"), F.col("n_name").alias("name"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k < 6 THEN 'Boek' || chr(CAST(65 + l_suppkey % 25 AS INTEGER)) END AS book, CASE WHEN k < 6 THEN l_orderkey % 50 + 1 END AS chapter,
CASE WHEN k = 2 THEN 1 WHEN k < 6 THEN l_linenumber END AS start, CASE WHEN k IN (0, 5) THEN l_linenumber + 2 WHEN k = 2 THEN 999 WHEN k < 6 THEN l_linenumber END AS "end" FROM (SELECT *, l_orderkey % 7 AS k FROM lineitem)""")
def tx1_parse_refs(spark, sf):
    li, aliases = _references(spark, sf)
    return structure.parse_refs(li, "q", aliases).select("l_orderkey", "l_linenumber", "ref.*")


def _references(spark, sf):
    """(l_orderkey, l_linenumber, q: a reference in one of seven forms), and the books' aliases."""
    name = F.concat(F.lit("Boek"), F.char(65 + F.col("n_nationkey")))
    aliases = t(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.lower(name).alias("alias"), name.alias("name"))
    book = F.concat(F.lit("Boek"), F.char(65 + F.col("l_suppkey") % 25))
    c, v, w = ((x).cast("string") for x in (F.col("l_orderkey") % 50 + 1, F.col("l_linenumber"), F.col("l_linenumber") + 2))
    forms = [F.concat(book, F.lit(" "), c, F.lit(":"), v, F.lit("-"), w), F.concat(F.lower(book), F.lit(" "), c, F.lit(" vers "), v), F.concat(book, F.lit("\u00a0 "), c), F.concat(book, F.lit(". "), c, F.lit(":"), v), F.concat(F.lower(book), c, F.lit(","), v)]
    forms += [F.concat(book, F.lit(" "), c, F.lit(" "), v, F.lit(" t/m "), w), F.concat(F.lit("Geen "), c, F.lit(":"), v)]
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.array(*forms), (F.col("l_orderkey") % 7).cast("int")).alias("q")), aliases


@query("WITH a AS (SELECT n_nationkey AS ord, lower(substr(n_name, 1, 4)) AS alias, n_name AS name FROM nation), q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(substr(n_name, 1, 4)) WHEN 2 THEN lower(substr(n_name, 1, 2)) ELSE 'zz' || n_name END AS k FROM part JOIN nation ON n_nationkey = p_partkey % 25) SELECT p_partkey, coalesce((SELECT max(name) FROM a WHERE lower(name) = lower(k)), (SELECT arg_min(name, ord) FROM a WHERE alias = lower(k)), (SELECT arg_min(name, ord) FROM a WHERE starts_with(alias, lower(k)))) AS name FROM q")
def tx2_resolve_alias(spark, sf):
    p = t(spark, sf, "part").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("p_partkey") % 25)
    m, n = F.col("p_partkey") % 4, F.col("n_name")
    p = p.select("p_partkey", F.when(m == 0, n).when(m == 1, F.lower(F.substring(n, 1, 4))).when(m == 2, F.lower(F.substring(n, 1, 2))).otherwise(F.concat(F.lit("zz"), n)).alias("k"))
    return structure.resolve_alias(p, "k", _aliases(spark, sf)).select("p_partkey", "name")


@query("""WITH q AS (SELECT lower(substr(p_name, 1, 3)) AS prefix FROM part UNION SELECT lower(substr(n_name, 1, 2)) FROM nation),
k AS (SELECT p_name AS name, lower(p_name) AS key, 0 AS kind, p_partkey AS ord FROM part UNION ALL SELECT n_name, lower(substr(n_name, 1, 4)), 1, n_nationkey FROM nation),
h AS (SELECT prefix, name, min(kind * 1000000000 + ord) AS ord FROM q JOIN k ON starts_with(key, prefix) GROUP BY 1, 2), r AS (SELECT prefix, name AS value, row_number() OVER (PARTITION BY prefix ORDER BY ord, name) - 1 AS place FROM h) SELECT prefix, value, place FROM r WHERE place < 7""")
def tx3_complete(spark, sf):
    p = t(spark, sf, "part")
    names = p.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("ord"))
    typed = p.select(F.lower(F.substring("p_name", 1, 3)).alias("prefix")).union(t(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 2))))
    return structure.complete(typed, "prefix", names, _aliases(spark, sf).withColumn("ord", F.col("ord").cast("int")))


@query(r"""WITH e AS (SELECT item_id AS id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name FROM benchmark),
n AS (SELECT id, name, list_filter(regexp_split_to_array(strip_accents(lower(name)), '\s+'), lambda x: x <> '') AS w FROM e),
key AS (SELECT key, min(id) AS id FROM (SELECT id, array_to_string(w, ' ') AS key FROM n UNION ALL SELECT id, list_filter(w, lambda x: length(x) >= 3)[-1] FROM n UNION ALL SELECT id, array_to_string(w[-2:], ' ') FROM n WHERE len(w) >= 2) WHERE length(key) >= 3 GROUP BY key),
q AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, w, list_transform(w, lambda x: strip_accents(lower(x))) AS f FROM q),
two AS (SELECT doc_id, i, id FROM (SELECT doc_id, i, f[i] || ' ' || f[i + 1] AS key FROM (SELECT doc_id, f, unnest(range(1, len(f))) AS i FROM f)) JOIN key USING (key)),
isle AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM two),
took AS (SELECT doc_id, i, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i - rn ORDER BY i) AS nth FROM isle) WHERE nth % 2 = 1),
used AS (SELECT doc_id, i FROM took UNION ALL SELECT doc_id, i + 1 FROM took),
one AS (SELECT doc_id, i, id FROM (SELECT doc_id, unnest(f) AS key, generate_subscripts(f, 1) AS i FROM f) JOIN key USING (key) ANTI JOIN used USING (doc_id, i)),
hit AS (SELECT doc_id, id, min(o) AS o FROM (SELECT doc_id, id, i - 1000000000 AS o FROM took UNION ALL SELECT doc_id, id, i FROM one) GROUP BY 1, 2),
ids AS (SELECT doc_id, string_agg(CAST(hit.id AS VARCHAR), ',' ORDER BY o) AS ids, string_agg(name, ',' ORDER BY o) AS names FROM hit JOIN e ON e.id = hit.id GROUP BY 1),
gone AS (SELECT doc_id, list(i) AS g FROM (SELECT doc_id, i FROM used UNION SELECT doc_id, i FROM one) GROUP BY 1)
SELECT doc_id, coalesce(ids, '') AS ids, coalesce(names, '') AS names, length(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS n_rest
FROM f LEFT JOIN ids USING (doc_id) LEFT JOIN gone USING (doc_id)""")
def tx4_extract_entities(spark, sf):
    e = t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("name"), F.col("item_id").alias("ord"))
    x = structure.extract_entities(_docs(spark, sf, "text"), "doc_id", "text", e)
    return x.select("doc_id", F.array_join("ids", ",").alias("ids"), F.array_join("names", ",").alias("names"), F.length("rest").alias("n_rest"))


@query("SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: strip_accents(lower(w)) NOT IN ('the', 'of')), ' ') AS rest FROM conversations")
def tx5_drop_entity(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", structure.drop_entity(F.col("text"), F.lit("The of")).alias("rest"))


_W = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({_W}, 'the') AND (list_contains({_W}, 'with') OR list_contains({_W}, 'from')) AND NOT list_contains({_W}, 'license') AND contains(' ' || array_to_string({_W}, ' ') || ' ', ' of the ')")
def tx6_text_search(spark, sf):
    return search.text_search(_docs(spark, sf, "text"), "text", 'the with or from -license "of the"').select("doc_id")


@query(f"SELECT doc_id, {_W}[1] AS term FROM documents WHERE list_has_all({_W}, ['and', 'of'])")
def tx6_plain_search(spark, sf):
    return search.text_search(_docs(spark, sf, "text"), "text", "and OF", "plain").select("doc_id", F.split(F.lower("text"), r"[^\p{L}\p{N}]+")[0].alias("term"))


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda w: regexp_full_match(w, 'onan(ingly|edly|ings|ing|ies|ed|ly|es|s)?'))) > 0")
def tx6_stemmed_search(spark, sf):
    return search.text_search(_docs(spark, sf, "text"), "text", "Onaning", "plain", lang="en").select("doc_id")


# Dutch stems, worked out again in SQL, step by step
_DUTCH = r"""WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
a AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(translate(word, 'äëïöüáéíóú', 'aeiouaeiou'), '(^|[aeiouyè])y', '\1Y', 'g'), '([aeiouyè])i([aeiouyè])', '\1I\2', 'g'), '([aeiouyè])i([aeiouyè])', '\1I\2', 'g') AS w FROM v WHERE word <> ''),
p AS (SELECT *, coalesce(nullif(length(regexp_extract(w, '^.*?[aeiouyè][^aeiouyè]')), 0), length(w)) AS p FROM a),
r AS (SELECT *, greatest(3, p) AS r1, p + coalesce(nullif(length(regexp_extract(substr(w, p + 1), '^.*?[aeiouyè][^aeiouyè]')), 0), length(w) - p) AS r2 FROM p),
s1 AS (SELECT *, regexp_extract(w, '(heden|ene|en|se|s)$', 1) AS e, substr(w, 1, length(w) - length(regexp_extract(w, '(heden|ene|en|se|s)$', 1))) AS stem FROM r),
t1 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(stem) < r1 THEN w WHEN e = 'heden' THEN stem || 'heid'
  WHEN e IN ('en', 'ene') THEN CASE WHEN regexp_matches(stem, '[^aeiouyè]$') AND NOT ends_with(stem, 'gem') THEN stem ELSE w END
  WHEN regexp_matches(stem, '[^aeiouyèj]$') THEN stem ELSE w END AS w, e IN ('en', 'ene') AND length(stem) >= r1 AND regexp_matches(stem, '[^aeiouyè]$') AND NOT ends_with(stem, 'gem') AS en FROM s1),
u1 AS (SELECT word, r1, r2, CASE WHEN en AND regexp_matches(w, '(kk|dd|tt)$') THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM t1),
t2 AS (SELECT *, ends_with(w, 'e') AND length(w) - 1 >= r1 AND regexp_matches(w, '[^aeiouyè]e$') AS e_went FROM u1),
v2 AS (SELECT word, r1, r2, e_went, CASE WHEN e_went AND regexp_matches(w, '(kk|dd|tt)e$') THEN substr(w, 1, length(w) - 2) WHEN e_went THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM t2),
t3 AS (SELECT *, ends_with(w, 'heid') AND length(w) - 4 >= r2 AND NOT ends_with(w, 'cheid') AS h FROM v2),
u3 AS (SELECT word, r1, r2, e_went, h, CASE WHEN h THEN substr(w, 1, length(w) - 4) ELSE w END AS w FROM t3),
w3 AS (SELECT word, r1, r2, e_went, h AND ends_with(w, 'en') AND length(w) - 2 >= r1 AND regexp_matches(w, '[^aeiouyè]en$') AND NOT ends_with(w, 'gemen') AS en, w FROM u3),
x3 AS (SELECT word, r1, r2, e_went, CASE WHEN en AND regexp_matches(w, '(kk|dd|tt)en$') THEN substr(w, 1, length(w) - 3) WHEN en THEN substr(w, 1, length(w) - 2) ELSE w END AS w FROM w3),
s4 AS (SELECT *, regexp_extract(w, '(end|ing|ig|lijk|baar|bar)$', 1) AS e, substr(w, 1, length(w) - length(regexp_extract(w, '(end|ing|ig|lijk|baar|bar)$', 1))) AS stem FROM x3),
t4 AS (SELECT word, r1, CASE WHEN e = '' OR length(stem) < r2 THEN w
  WHEN e IN ('end', 'ing') THEN CASE WHEN ends_with(stem, 'ig') AND length(stem) - 2 >= r2 AND NOT ends_with(stem, 'eig') THEN substr(stem, 1, length(stem) - 2) WHEN regexp_matches(stem, '(kk|dd|tt)$') THEN substr(stem, 1, length(stem) - 1) ELSE stem END
  WHEN e = 'ig' THEN CASE WHEN ends_with(stem, 'e') THEN w ELSE stem END
  WHEN e = 'lijk' THEN CASE WHEN length(stem) - 1 >= r1 AND regexp_matches(stem, '(kk|dd|tt)e$') THEN substr(stem, 1, length(stem) - 2) WHEN length(stem) - 1 >= r1 AND regexp_matches(stem, '[^aeiouyè]e$') THEN substr(stem, 1, length(stem) - 1) ELSE stem END
  WHEN e = 'baar' OR e_went THEN stem ELSE w END AS w FROM s4),
stem AS (SELECT word, lower(CASE WHEN regexp_matches(w, '[^aeiouyè](aa|ee|oo|uu)[^aeiouyèI]$') THEN substr(w, 1, length(w) - 2) || right(w, 1) ELSE w END) AS stem FROM t4)
"""
_DUTCH_HITS = _DUTCH + "SELECT doc_id FROM documents WHERE list_has_any(" + _W + ", (SELECT list(word) FROM stem WHERE stem = 'onan'))"


@query(_DUTCH_HITS)
def tx6_dutch_search(spark, sf):
    return search.text_search(_docs(spark, sf, "text"), "text", "Onanen", "plain", lang="dutch").select("doc_id")


def _indexed(spark, sf, query, mode="websearch", lang=None):
    """The documents that an index over all texts finds; the index goes when its hits are written."""
    scratch, path = Scratch(spark), shared_folder(spark)
    search_index.write_index(_docs(spark, sf, "text"), "doc_id", "text", path, lang)
    hits = scratch.keep(search_index.search_index(spark, path, query, mode))
    scratch.remove(path)
    return hits.select(F.col("key").alias("doc_id"))


@query(SQL["tx6_text_search"])
def tx6_index_search(spark, sf):
    return _indexed(spark, sf, 'the with or from -license "of the"')


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_W}, ' ') || ' ', ' in the of ')")
def tx6_index_phrase(spark, sf):
    return _indexed(spark, sf, "in the OF", "phrase")


@query(f"SELECT doc_id FROM documents WHERE NOT list_contains({_W}, 'the') AND (NOT list_contains({_W}, 'de') OR list_contains({_W}, 'und'))")
def tx6_index_without(spark, sf):
    """Only what is forbidden: documents without any of the asked terms are hits too."""
    return _indexed(spark, sf, "-the -de or und")


@query(_DUTCH_HITS)
def tx6_index_dutch(spark, sf):
    return _indexed(spark, sf, "Onanen", "plain", "dutch")


@query("SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(" + _W + ") AS term FROM documents) WHERE term <> '' GROUP BY 1")
def tx6_token_table(spark, sf):
    return search.token_table(_docs(spark, sf, "text"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _paragraph_sql(source: str, shown: str) -> str:
    some = lambda a: f"list_filter(list_transform({a}, lambda p: {_sql_trim('p')}), lambda p: p <> '')"
    return rf"""WITH RECURSIVE x AS (SELECT doc_id, {_sql_trim(source)} AS t FROM documents),
p AS (SELECT doc_id, t, {some(r"regexp_split_to_array(t, '\n[ \t]*\n\s*')")} AS b, {some("string_split(t, chr(10))")} AS l FROM x),
c AS (SELECT doc_id, t AS rest, 0 AS n, '' AS piece FROM p WHERE len(b) < 2 AND len(l) < 2 AND length(t) >= 600
UNION ALL SELECT doc_id, substr(rest, length(piece) + 1), n, piece FROM (SELECT doc_id, rest, n + 1 AS n, coalesce(nullif(regexp_extract(substr(rest, 1, 501), '(?s)^(.{{249,499}}[.!?])(?:\s|$)', 1), ''), substr(rest, 1, 500)) AS piece FROM c WHERE rest <> '')),
d AS (SELECT doc_id, list({_sql_trim("piece")} ORDER BY n) AS pieces FROM c WHERE n > 0 GROUP BY doc_id),
a AS (SELECT doc_id, CASE WHEN len(b) > 1 THEN b WHEN len(l) > 1 THEN l WHEN pieces IS NOT NULL THEN list_filter(pieces, lambda p: p <> '') ELSE list_filter([t], lambda p: p <> '') END AS paras FROM p LEFT JOIN d USING (doc_id))
SELECT doc_id, pos, {shown} FROM (SELECT doc_id, unnest(range(len(paras))) AS pos, unnest(paras) AS para FROM a)"""


@query(_paragraph_sql("text", "para"))
def tx7_paragraphs(spark, sf):
    return structure.paragraphs(t(spark, sf, "documents"), "doc_id", "text")


@query(_paragraph_sql("replace(text, chr(10), ' ')", "length(para) AS n"))
def tx7_pieces(spark, sf):
    flat = _docs(spark, sf, F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return structure.paragraphs(flat, "doc_id", "text").select("doc_id", "pos", F.length("para").alias("n"))


@query(r"""WITH RECURSIVE a AS (SELECT doc_id, [substr(text, 1, 1), substr(text, 2)] || string_split(text, chr(10)) AS p FROM documents),
f AS (SELECT doc_id, p, 1 AS i, p[1] AS last, 1 AS n, p[1] AS first FROM a
UNION ALL SELECT doc_id, p, i + 1, CASE WHEN j THEN last || x ELSE x END, CASE WHEN j THEN n ELSE n + 1 END, CASE WHEN j AND n = 1 THEN last || x ELSE first END
FROM (SELECT *, p[i + 1] AS x, regexp_full_match(last, '\p{L}{1,3}') AND regexp_matches(p[i + 1], '^\p{Ll}') AS j FROM f WHERE i < len(p)))
SELECT doc_id, n, first FROM f WHERE i = len(p)""")
def tx8_merge_dropcaps(spark, sf):
    cut = F.concat(F.array(F.substring("text", 1, 1), F.substring("text", F.lit(2), F.length("text"))), F.split("text", "\n"))
    return _docs(spark, sf, structure.merge_dropcaps(cut).alias("m")).select("doc_id", F.size("m").alias("n"), F.get("m", F.lit(0)).alias("first"))


@query("SELECT conv_id, n - 1 AS pos, n AS number, trim(regexp_replace(regexp_replace(text, '[.!?;:0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) || '.' AS line FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def tx9_numbered_lines(spark, sf):
    c = windows.ordinal(t(spark, sf, "conversations"), "conv_id", "turn", "n")
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", "[.!?;:0-9]+", " "), r"\s+", " "))
    verse = F.concat(F.col("n").cast("string"), F.lit(" "), bare, F.lit("."))
    joined = c.withColumn("v", verse).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), " ").alias("text"))
    return structure.numbered_lines(joined, "conv_id", "text")


@query(f"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'Vs. ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' ' || replace(text, chr(10), ' ') AS l FROM conversations),
g AS (SELECT conv_id, 'intro' || chr(10) || string_agg(l, chr(10) ORDER BY n) AS whole, {_sql_trim("'intro' || chr(10) || coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (n BETWEEN 2 AND 3), '')")} AS cut FROM c GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(cut) >= 40 THEN cut ELSE whole END AS cut FROM g""")
def tx10_extract_range(spark, sf):
    c = windows.ordinal(t(spark, sf, "conversations"), "conv_id", "turn", "n")
    line = F.concat(F.lit("Vs. "), F.col("n").cast("string"), F.lit(" "), F.regexp_replace("text", "\n", " "))
    doc = c.withColumn("l", line).groupBy("conv_id").agg(F.concat(F.lit("intro\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]), "\n")).alias("text"))
    return doc.select("conv_id", structure.extract_range(F.col("text"), F.lit(2), F.lit(3)).alias("cut"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '3. Preek over X EEN TITEL 2' END AS title, CASE doc_id % 3 WHEN 0 THEN 'de tekst vervolg' WHEN 1 THEN 'de tekst' END AS quote,
length({_sql_trim(_sql_rules("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1. Vraag hoe' || chr(10) ELSE 'Over een preek' || chr(10) || chr(10) END || text", text.DEBRIS))}) AS n_body FROM documents""")
def tx11_split_sections(spark, sf):
    head = F.lit("3. Preek over X\nEEN TITEL 2\n \nTekst :\nde tekst\n")
    k = F.col("doc_id") % 3
    doc = F.when(k == 0, F.concat(head, F.lit("vervolg\n\n"), "text")).when(k == 1, F.concat(head, F.lit("1. Vraag hoe\n"), "text")).otherwise(F.concat(F.lit("Over een preek\n\n"), "text"))
    return _docs(spark, sf, structure.split_sections(doc).alias("s")).select("doc_id", "s.title", "s.quote", F.length("s.body").alias("n_body"))


_MARK = f"(?:[{structure.DELIMITERS}]|{text.SPACE})"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text || ' a b,c. (d) e;f g' || chr(10) || 'h:' AS t FROM documents),
f AS (SELECT doc_id, t, 0 AS k, 0 AS u, 0 AS missed, -1 AS pos FROM d
UNION ALL SELECT doc_id, t, k + 1, CASE WHEN p > 0 THEN greatest(u - 1, 0) + p + 1 ELSE u END, CASE WHEN p > 0 THEN 0 ELSE missed + 1 END, CASE WHEN p > 0 THEN greatest(u - 1, 0) + p ELSE -1 END
FROM (SELECT *, length(regexp_extract(substr(t, greatest(u - 1, 0) + 1), '(?s)^(.*?{_MARK})' || chr(97 + k) || '{_MARK}', 1)) AS p FROM f WHERE k < 26 AND missed < 3))
SELECT doc_id, chr(96 + k) AS marker, pos FROM f WHERE pos >= 0""")
def tx12_marker_tokens(spark, sf):
    marked = F.concat("text", F.lit(" a b,c. (d) e;f g\nh:"))
    return _docs(spark, sf, F.explode(structure.marker_tokens(marked)).alias("m")).select("doc_id", "m.marker", "m.pos")


@query(r"""WITH c AS (SELECT conv_id, turn, role, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS ctx FROM conversations WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 10 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT conv_id, turn, ctx || chr(10) || 'Vs. 2 not shown' AS whole, ctx AS cut, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS rn, count(*) OVER () AS n FROM c WHERE role = 'user' OR NOT EXISTS (SELECT 1 FROM c WHERE role = 'user')),
x AS (SELECT *, CASE WHEN length(cut) >= 40 THEN cut ELSE whole END AS ctx FROM d),
e AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT day, conv_id, turn, CASE WHEN length(ctx) <= 250 THEN ctx ELSE coalesce(nullif(regexp_extract(substr(ctx, 1, 251), '(?s)^(.+) [^ ]*$', 1), ''), substr(ctx, 1, 250)) || '…' END AS card FROM e JOIN x ON rn = dayofyear(day) % n""")
def tx13_daily_card(spark, sf):
    """Non-blank units (F16), of the preferred kind if there are any (U3), one a day (W12) with its neighbours (J11), cut to the asked verses (TX10) and to 250 characters (T2)."""
    c = t(spark, sf, "conversations").where(filters.nonblank(F.col("text"), 10))
    c = joins.context(c, "conv_id", "turn", "text").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    days = t(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    card = windows.daily_pick(setops.prefer_or_any(c, F.col("role") == "user"), "k", days, "day")
    cut = structure.extract_range(F.concat("context", F.lit("\nVs. 2 not shown")), F.lit(1), F.lit(1))
    return card.select("day", "conv_id", "turn", text.truncate_words(cut, 250).alias("card"))


@query("SELECT o_custkey AS week, day, o_custkey || '-' || day AS progress_key, book, chapter FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS day, o_orderkey AS book, o_orderpriority AS chapter FROM orders)")
def tx14_plan_rows(spark, sf):
    plan = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("week")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("book"), F.col("o_orderpriority").alias("chapter")))).alias("readings"))
    return structure.plan_rows(plan, "week", "readings")


@query("SELECT n_nationkey, n_regionkey, 'R' || n_regionkey AS region FROM nation WHERE n_regionkey < 3")
def tx15_load_rules(spark, sf):
    rules = structure.load_rules(spark, [(str(i), f"R{i}") for i in range(3)])
    n = t(spark, sf, "nation").join(rules, F.col("n_regionkey").cast("string") == F.col("alias"))
    return n.select("n_nationkey", "n_regionkey", F.col("name").alias("region"))


@query("SELECT p_partkey, unnest(range(1, p_size % 6 + 1)) AS number FROM part")
def tx16_expand_counts(spark, sf):
    return structure.expand_counts(t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 6).alias("n")), "p_partkey", "n")


# vectors


def _vectors(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "embedding", "label")


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 10000000, -1 FROM embeddings WHERE vec_id % 10 = 1")
def vx1_put_vectors(spark, sf):
    v = _vectors(spark, sf)
    new = v.where("vec_id % 10 < 2").select(F.when(F.col("vec_id") % 10 == 1, F.col("vec_id") + 10000000).otherwise(F.col("vec_id")).alias("vec_id"), "embedding", F.lit(-1).cast(v.schema["label"].dataType).alias("label"))
    return vectors.put_vectors(v, new).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 = 0")
def vx2_get_vectors(spark, sf):
    v = _vectors(spark, sf)
    return vectors.get_vectors(v, v.where("vec_id % 7 = 0")).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 4 = 3")
def vx3_list_vectors(spark, sf):
    return vectors.list_vectors(_vectors(spark, sf), 3, 4).select("vec_id", "label")


_NEAR = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, {score} AS score FROM q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings))
SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query(_NEAR.format(score="list_cosine_similarity(a, b)", order="score"))
def vx4_query_cosine(spark, sf):
    v = _vectors(spark, sf)
    return vectors.query_vectors(v, v.where("vec_id % 50 = 0"), 10).withColumn("score", F.round("score", 5))


@query(_NEAR.format(score="0 - list_distance(a, b)", order="score"))
def vx4_query_l2(spark, sf):
    v = _vectors(spark, sf)
    return vectors.query_vectors(v, v.where("vec_id % 50 = 0"), 10, "l2").withColumn("score", F.round("score", 5) + F.lit(0.0))  # no negative zero


def _vector_index(spark, sf, metric):
    path = shared_folder(spark)
    vector_index.write_vectors(_vectors(spark, sf), path, metric)
    return path


def _by_index(spark, sf, metric, probe=None):
    path = _vector_index(spark, sf, metric)
    found = vector_index.query_index(spark, path, _vectors(spark, sf).where("vec_id % 50 = 0"), 10, probe)  # its rows are written
    Scratch(spark).remove(path)
    return found


@query(SQL["vx4_query_cosine"])
def vx4_index_cosine(spark, sf):
    return _by_index(spark, sf, "cosine").withColumn("score", F.round("score", 5))


@query(SQL["vx4_query_l2"])
def vx4_index_l2(spark, sf):
    return _by_index(spark, sf, "l2").withColumn("score", F.round("score", 5) + F.lit(0.0))


@query("SELECT count(*) AS n_queries, 10 * count(*) AS n_true, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vx4_index_recall(spark, sf):
    """Whether approximate queries, by as many cells as calibration says, find nine tenths of the exact neighbours."""
    v, path = _vectors(spark, sf), _vector_index(spark, sf, "cosine")
    asked = v.where("vec_id % 50 = 0")
    probe = vector_index.calibrate(spark, path, target=0.99)  # the queries are few, and their recall strays from the measured one
    found = vector_index.query_index(spark, path, asked, 10, probe).select("query_id", "vec_id", F.lit(True).alias("found"))
    Scratch(spark).remove(path)
    exact = vectors.query_vectors(v, asked, 10).select("query_id", "vec_id")
    met = exact.join(found, ["query_id", "vec_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("reached"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def vx5_delete_vectors(spark, sf):
    v = _vectors(spark, sf)
    return vectors.delete_vectors(v, v.where("vec_id % 7 = 0")).select("vec_id", "label")


# named functions


def _documents_like(spark, sf_dir, needle):
    return t(spark, sf_dir, "documents").where(F.contains("text", F.lit(needle))).select("doc_id", "lang")


registry.register_function("documents_like", _documents_like)


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'ing') AND lang = 'en'")
def fn1_call_function(spark, sf):
    return registry.call_function("documents_like", spark=spark, sf_dir=sf, needle="ing").where("lang = 'en'")


@query("SELECT count(*) AS n FROM documents WHERE contains(text, 'ing')")
def fn1_count_only(spark, sf):
    return registry.call_function("documents_like", spark=spark, sf_dir=sf, needle="ing", count_only=True)


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def fn2_fold_all(spark, sf):
    return _docs(spark, sf, udfs.fold_all("text").alias("folded"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '\\S')")
def fn3_table_function(spark, sf):
    registry.register_table_functions(spark)
    t(spark, sf, "documents").createOrReplaceTempView("corpus_documents")
    return spark.sql("SELECT doc_id, pos, line FROM corpus_documents, LATERAL text_lines(text)")


@query(_paragraph_sql("text", "para"))
def fn3_paragraph_function(spark, sf):
    registry.register_table_functions(spark)
    t(spark, sf, "documents").createOrReplaceTempView("corpus_documents")
    return spark.sql("SELECT doc_id, pos, para FROM corpus_documents, LATERAL text_paragraphs(text)")


@query("""SELECT l_orderkey, l_linenumber, 'Boek' || chr(CAST(65 + l_suppkey % 25 AS INTEGER)) AS book, l_orderkey % 50 + 1 AS chapter,
CASE WHEN k = 2 THEN 1 ELSE l_linenumber END AS start, CASE WHEN k IN (0, 5) THEN l_linenumber + 2 WHEN k = 2 THEN 999 ELSE l_linenumber END AS "end" FROM (SELECT *, l_orderkey % 7 AS k FROM lineitem) WHERE k < 6""")
def fn3_reference_function(spark, sf):
    li, aliases = _references(spark, sf)
    registry.register_references(spark, aliases)
    li.createOrReplaceTempView("corpus_references")
    return spark.sql("SELECT l_orderkey, l_linenumber, r.* FROM corpus_references, LATERAL refs(q) AS r")
