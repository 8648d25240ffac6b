"""Joins, aggregates, windows and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import setops as u
from ..operators import windows as w
from ..sources.shared import Scratch
from .registry import query
from .registry import table as t

# joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j1_embed(spark, sf):
    o = j.embed(t(spark, sf, "orders"), t(spark, sf, "customer"), ("o_custkey", "c_custkey"), ["c_name", "c_mktsegment"], "customer")
    return o.select("o_orderkey", "customer.c_name", "customer.c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j2_embed_inner(spark, sf):
    li = j.embed(t(spark, sf, "lineitem"), t(spark, sf, "orders").where("o_orderstatus = 'F'"), ("l_orderkey", "o_orderkey"), ["o_orderpriority"], "o", "inner")
    return li.select("l_orderkey", "l_linenumber", "o.o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, a.n_name AS supplier_nation, b.n_name AS customer_nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey")
def j3_role_playing(spark, sf):
    n = t(spark, sf, "nation")
    li = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = j.embed(j.embed(li, n, ("s_nationkey", "n_nationkey"), ["n_name"], "sn", "inner"), n, ("c_nationkey", "n_nationkey"), ["n_name"], "cn", "inner")
    return li.select("l_orderkey", "l_linenumber", F.col("sn.n_name").alias("supplier_nation"), F.col("cn.n_name").alias("customer_nation"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j4_two_levels(spark, sf):
    n = j.embed(t(spark, sf, "nation"), t(spark, sf, "region"), ("n_regionkey", "r_regionkey"), ["r_name"], "region")
    c = j.embed(t(spark, sf, "customer"), n, ("c_nationkey", "n_nationkey"), ["n_name", "region"], "nation")
    return c.select("c_custkey", "nation.n_name", "nation.region.r_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j5_semi(spark, sf):
    keys = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return j.semi(t(spark, sf, "lineitem"), keys, ("l_orderkey", "o_orderkey")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j6_anti(spark, sf):
    return j.anti(t(spark, sf, "orders"), t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), ("o_custkey", "c_custkey")).select("o_orderkey")


@query("SELECT c_custkey, (SELECT min(n_nationkey) FROM nation WHERE CAST(n_nationkey AS VARCHAR) = v OR n_name = v) AS found_id FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE (SELECT n_name FROM nation n WHERE n.n_nationkey = c_nationkey) END AS v FROM customer)")
def j7_lookup_any(spark, sf):
    n = t(spark, sf, "nation")
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.col("n_name")).alias("v"))
    return j.lookup_any(c, n, "v", ["n_nationkey", "n_name"], "n_nationkey").select("c_custkey", "found_id")


def _refs(spark, sf, shift):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + shift).alias("lo"), (F.col("o_orderkey") % 4 + shift + 1).alias("hi"))


@query("SELECT l_orderkey, l_linenumber, lo, hi FROM (SELECT o_orderkey, o_orderkey % 4 + 1 AS lo, o_orderkey % 4 + 2 AS hi FROM orders) JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN lo AND hi")
def j8_range_join(spark, sf):
    return j.range_join(_refs(spark, sf, 1), t(spark, sf, "lineitem"), ["l_orderkey"], "lo", "hi", "l_linenumber").select("l_orderkey", "l_linenumber", "lo", "hi")


@query("WITH r AS (SELECT o_orderkey, o_orderkey % 4 + 4 AS lo, o_orderkey % 4 + 5 AS hi, last FROM orders JOIN (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM r JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN least(lo, r.last) AND greatest(hi, least(lo, r.last)) GROUP BY l_orderkey")
def j9_range_join_clamped(spark, sf):
    found = j.range_join_clamped(_refs(spark, sf, 4), t(spark, sf, "lineitem"), ["l_orderkey"], "lo", "hi", "l_linenumber")
    return found.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT l_orderkey AS g, l_linenumber AS s, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_linenumber + l_suppkey % 4 - 1 END AS e, CASE WHEN l_partkey % 7 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS eg FROM lineitem),
sel AS (SELECT l_orderkey AS g, l_linenumber AS pos FROM lineitem WHERE l_quantity > 40)
SELECT g, s, e FROM p WHERE EXISTS (SELECT 1 FROM sel WHERE sel.g = p.g AND pos BETWEEN s AND CASE WHEN eg = p.g AND e >= s THEN e ELSE s END)""")
def j10_interval_overlap(spark, sf):
    li = t(spark, sf, "lineitem")
    p = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("s"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_linenumber") + F.col("l_suppkey") % 4 - 1).alias("e"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("eg"))
    sel = li.where("l_quantity > 40").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("pos"))
    return j.interval_overlap(p, sel, "g", "s", "e", "eg", "pos").select("g", "s", "e")


@query("SELECT conv_id, turn, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def j11_context(spark, sf):
    return j.context(t(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) ORDER BY l_quantity DESC, l_suppkey, l_partkey LIMIT 30")
def j12_neighbours(spark, sf):
    sel = t(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return j.neighbours(t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), sel, "l_partkey", "l_suppkey", "l_quantity", 30)


@query("SELECT o_orderkey, o_orderstatus, min(l_partkey) AS first_unit FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY 1, 2")
def j13_cited_by(spark, sf):
    proofs = t(spark, sf, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    sel = t(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return j.cited_by(proofs, t(spark, sf, "orders"), sel, "l_partkey", "o_orderkey").select("o_orderkey", "o_orderstatus", "first_unit")


@query("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS n_customers FROM supplier")
def j14_count_children(spark, sf):
    by_nation = j.count_children(t(spark, sf, "supplier"), "s_suppkey", {"n_lines": (t(spark, sf, "lineitem"), "l_suppkey")})
    return j.count_children(by_nation, "s_nationkey", {"n_customers": (t(spark, sf, "customer"), "c_nationkey")}).select("s_suppkey", "n_lines", "n_customers")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_size, 0) AS lookup FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey ORDER BY lookup, l_orderkey, l_linenumber")
def j15_order_by_lookup(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return j.order_by_lookup(li, t(spark, sf, "part").where("p_size > 10"), ("l_partkey", "p_partkey"), "p_size", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "lookup")


@query("SELECT o_orderkey, coalesce((SELECT string_agg(l_linenumber, ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45), '') AS items FROM orders")
def j16_grouped_left(spark, sf):
    g = j.grouped_left(t(spark, sf, "orders"), t(spark, sf, "lineitem").where("l_quantity > 45"), ("o_orderkey", "l_orderkey"), F.col("l_linenumber"))
    return g.select("o_orderkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("WITH plan AS (SELECT o_orderkey AS plan_id, n_name AS name, o_orderkey AS ch, 1 + o_orderkey % 2 AS lo, 3 AS hi FROM orders JOIN nation ON n_nationkey = o_orderkey % 30 UNION ALL SELECT o_orderkey, 'nowhere', o_orderkey, 1, 3 FROM orders WHERE o_orderkey % 30 >= 25) SELECT plan_id, string_agg(l_partkey, ' ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS texts FROM plan LEFT JOIN nation ON n_name = name LEFT JOIN lineitem ON l_orderkey = ch AND n_nationkey = l_orderkey % 30 AND l_linenumber BETWEEN lo AND hi GROUP BY plan_id")
def j17_plan_join(spark, sf):
    n = t(spark, sf, "nation")
    o = t(spark, sf, "orders").join(n, F.col("n_nationkey") == F.col("o_orderkey") % 30, "left")
    plan = o.select(F.col("o_orderkey").alias("plan_id"), F.coalesce("n_name", F.lit("nowhere")).alias("name"), F.col("o_orderkey").alias("plan_chapter"), (1 + F.col("o_orderkey") % 2).alias("lo"), F.lit(3).alias("hi"))
    units = t(spark, sf, "lineitem").select((F.col("l_orderkey") % 30).cast("int").alias("n_nationkey"), "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("t"))
    return j.plan_join(plan, n, units, "name", "n_nationkey", "n_name", "l_orderkey", "l_linenumber", "t").select("plan_id", "texts")


@query("WITH q AS (SELECT doc_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9#]+'), lambda w: w <> '') AS w FROM documents), g AS (SELECT query_id, unnest(w) AS gram FROM q UNION SELECT query_id, w[i] || ' ' || w[i + 1] FROM (SELECT query_id, w, unnest(range(1, len(w))) AS i FROM q)) SELECT DISTINCT query_id, item_id AS entity_id FROM g JOIN (SELECT item_id, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS name FROM benchmark) ON gram = name")
def j18_match_entities(spark, sf):
    names = t(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("name"))
    return j.match_entities(t(spark, sf, "documents"), "doc_id", "text", names, "item_id", "name")


# aggregates


@query("SELECT count(*) AS n FROM orders")
def a1_count(spark, sf):
    return a.count_rows(t(spark, sf, "orders"))


@query("SELECT count(*) AS n FROM lineitem")
def a2_count_estimated(spark, sf):
    """Exact for tables of a few files, as that of the SQL check is."""
    return a.count_rows(t(spark, sf, "lineitem"), "estimated", 0.05)


@query("SELECT true AS within, count(*) > 0 AS some FROM lineitem WHERE l_quantity > 25")
def a2_count_bounded(spark, sf):
    """Whether the count lies within the estimate's bound, for a selection dealt over 60 files, of which 20 are counted."""
    scratch, li = Scratch(spark), t(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    dealt = scratch.keep(li.repartition(60, "l_orderkey"))
    wanted = dealt.where("l_quantity > 25")
    out = scratch.keep(a.estimated_count(wanted).crossJoin(a.count_rows(wanted).withColumnRenamed("n", "exact")))
    scratch.drop(dealt)
    return out.select((F.abs(F.col("n") - F.col("exact")) <= F.col("bound")).alias("within"), (F.col("n") > 0).alias("some"))


_EIGHT = ["nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {n}" for n in _EIGHT))
def a3_count_tables(spark, sf):
    return a.count_tables({n: t(spark, sf, n) for n in _EIGHT})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def a4_group_count(spark, sf):
    return a.group_count(t(spark, sf, "orders"), "o_custkey")


@query("SELECT l_suppkey, l_returnflag, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey) AS total FROM lineitem GROUP BY 1, 2")
def a5_count_by(spark, sf):
    return a.count_by(t(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS items, count(*) AS n FROM orders GROUP BY 1")
def a6_collect_groups(spark, sf):
    return a.collect_groups(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT coalesce(r_name, 'other') AS \"outer\", coalesce(n_name, 'other') AS \"inner\", string_agg(s_name, ',' ORDER BY s_name) AS items FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def a7_nested_groups(spark, sf):
    n = t(spark, sf, "nation").where("n_nationkey % 3 > 0").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    g = a.nested_groups(s, "r_name", "n_name", "s_name").select("outer", F.explode("groups").alias("g"))
    return g.select("outer", "g.inner", F.array_join("g.items", ",").alias("items"))


@query("SELECT r_name, n_name, count(*) AS n, grouping_id(r_name, n_name) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def a8_rollup(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return a.rollup_counts(c, "r_name", "n_name")


@query("SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_quantity > 10 THEN l_returnflag END, ',' ORDER BY l_linenumber, l_returnflag), '') AS markers FROM lineitem GROUP BY 1")
def a9_markers(spark, sf):
    return a.markers(t(spark, sf, "lineitem").withColumn("m", F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))), "l_orderkey", "l_linenumber", "m")


@query("SELECT DISTINCT p_size % 20 AS size FROM part WHERE p_size % 20 <> 0")
def a10_distinct_sorted(spark, sf):
    return a.distinct_sorted(t(spark, sf, "part").select((F.col("p_size") % 20).alias("size")), "size")


@query("SELECT l_suppkey, string_agg(p, ',' ORDER BY p) AS chapters FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem) GROUP BY 1")
def a11_table_of_contents(spark, sf):
    return a.table_of_contents(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn = 1")
def a12_first_distinct(spark, sf):
    return a.first_distinct(t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], ["n_chars", "doc_id"]).select("source", "doc_id")


@query("SELECT b AS bucket, count(*) AS n, CASE WHEN b = 0 THEN 'Overig' ELSE CAST(b AS VARCHAR) END AS label FROM (SELECT coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size % 10 END, 0) AS b FROM part) GROUP BY 1")
def a13_bucket_groups(spark, sf):
    p = t(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") % 10).alias("day"))
    return a.bucket_groups(p, "day", "Overig")


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS c FROM documents) SELECT c, count(*) AS n, min(doc_id) AS first_id FROM d WHERE c IS NOT NULL GROUP BY c UNION ALL (SELECT c, 1, doc_id FROM d WHERE c IS NULL ORDER BY doc_id LIMIT 5)")
def a14_split_collections(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("c"))
    return a.split_collections(d, "c", "doc_id")


@query("SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) FILTER (value > 50) AS n_done, bool_and(value > 50) AS all_done, bool_or(value > 50) AS any_done, CAST(floor(count(*) FILTER (value > 50) * 100 / 7) AS BIGINT) AS percent FROM events GROUP BY 1, 2")
def a15_progress(spark, sf):
    e = t(spark, sf, "events").withColumn("week", F.date_trunc("week", "ts").cast("date"))
    return a.progress(e, ["user_id", "week"], F.col("value") > 50)


@query("SELECT doc_id, count(*) FILTER (n_chars < 700) OVER (PARTITION BY source) >= ceil(count(*) OVER (PARTITION BY source) / 2) AS majority FROM documents")
def a16_majority(spark, sf):
    return a.majority_flag(t(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", F.col("n_chars") < 700).select("doc_id", "majority")


@query("SELECT c_name, n1, n2, n1 + n2 AS total FROM (SELECT c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n1, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n2 FROM customer) ORDER BY total DESC, c_name LIMIT 10")
def a17_top_entities(spark, sf):
    o = t(spark, sf, "orders")
    c = j.count_children(t(spark, sf, "customer"), "c_custkey", {"n1": (o, "o_custkey"), "n2": (o.where("o_orderstatus = 'F'"), "o_custkey")})
    return a.top_entities(c.select("c_name", "n1", "n2"), "c_name", ["n1", "n2"])


_THEMES = ["the", "und", "de", "que", "token", "license", "idiot", "genade"]


@query("WITH d AS (SELECT regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+') AS w FROM documents) SELECT theme, (SELECT count(*) FROM d WHERE list_contains(w, theme)) AS n FROM (VALUES " + ", ".join(f"('{x}')" for x in _THEMES) + ") AS v(theme)")
def a18_theme_counts(spark, sf):
    return a.theme_counts(t(spark, sf, "documents"), "text", _THEMES)


@query("SELECT 'documents' AS facet, count(*) AS n FROM documents WHERE source = 'src1' UNION ALL SELECT 'labelled', count(*) FROM labels JOIN documents USING (doc_id) WHERE source = 'src1'")
def a19_facet_counts(spark, sf):
    d = t(spark, sf, "documents").where("source = 'src1'").select("doc_id")
    return a.facet_counts({"documents": d, "labelled": t(spark, sf, "labels").join(d, "doc_id")})


# windows


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_returnflag = 'R' DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def w1_dedup_prefer(spark, sf):
    li = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return w.dedup_prefer(li, ["l_partkey", "l_suppkey"], F.col("l_returnflag") == "R", ["l_orderkey", "l_linenumber"]).drop("l_returnflag")


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w2_neighbours_in_group(spark, sf):
    return w.neighbours_in_group(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").drop("o_custkey")


@query("SELECT o_custkey, o_orderkey, rank, group_size FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders) WHERE rank <= 3")
def w3_top_n_per_group(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return w.top_n_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"]).drop("o_totalprice")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents")
def w4_ordinal(spark, sf):
    return w.ordinal(t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").drop("source")


@query("WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY 1, 2, 3")
def w5_runs(spark, sf):
    return w.runs(t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")


_PACK = """d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS rn FROM x),
p AS (SELECT *, size AS used, 1 AS page FROM d WHERE rn = 1
UNION ALL SELECT d.*, CASE WHEN used > 0 AND used + d.size > {budget} THEN d.size ELSE used + d.size END, CASE WHEN used > 0 AND used + d.size > {budget} THEN page + 1 ELSE page END FROM p JOIN d ON d.g = p.g AND d.rn = p.rn + 1)"""


@query("WITH RECURSIVE x AS (SELECT source AS g, doc_id, n_chars, n_chars + 20 AS size FROM documents), " + _PACK.format(order="doc_id", budget=1800) + " SELECT doc_id, g AS source, n_chars, page FROM p")
def w6_pack_pages(spark, sf):
    return w.pack_pages(t(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], F.col("n_chars") + 20)


@query("WITH RECURSIVE s AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\n'), lambda q: length(trim(q)) > 0) AS a FROM documents), x AS (SELECT source AS g, doc_id, unnest(range(len(a))) AS pos, length(unnest(a)) + CASE WHEN unnest(range(len(a))) = 0 THEN 30 ELSE 0 END AS size FROM s), " + _PACK.format(order="doc_id, pos", budget=1800) + " SELECT g AS source, doc_id, pos, page FROM p")
def w7_pack_paragraphs(spark, sf):
    d = t(spark, sf, "documents").select("source", "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return w.pack_paragraphs(d, "source", "doc_id", "text", header=30).select("source", "doc_id", "pos", "page")


@query("WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), x AS (SELECT doc_id AS g, unnest(range(len(a))) AS pos, length(unnest(a)) AS size FROM s), " + _PACK.format(order="pos", budget=2400) + " SELECT g AS doc_id, page, count(*) AS n_lines, sum(size) + count(*) - 1 AS n_chars FROM p GROUP BY 1, 2")
def w8_pack_lines(spark, sf):
    return w.pack_lines(t(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "page", "n_lines", F.length("page_text").alias("n_chars"))


@query("WITH RECURSIVE x AS (SELECT source AS g, doc_id, lang, n_chars AS size FROM documents), " + _PACK.format(order="doc_id", budget=1800) + " SELECT doc_id AS request, CASE doc_id % 3 WHEN 0 THEN page WHEN 1 THEN min(page) OVER (PARTITION BY g, lang) ELSE 2 END AS page FROM p")
def w9_locate_page(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"), F.col("lang").alias("unit"), "n_chars")
    pages = w.pack_pages(d, "grp", ["doc_id"], F.col("n_chars")).drop("n_chars")
    m = F.col("doc_id") % 3
    wanted = d.select(F.col("doc_id").alias("request"), "grp", F.when(m == 0, F.col("doc_id")).alias("want_entry"), F.when(m == 1, F.col("unit")).alias("want_unit"), F.lit(2).alias("want_page"))
    return w.locate_page(pages, "grp", "doc_id", wanted)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 99 END AS place FROM orders ORDER BY 2, 1")
def w10_order_by_list(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", w.list_rank(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).alias("place"))
    return o.orderBy("place", "o_orderkey")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 97 = 0 THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END, doc_id) AS rn FROM documents) WHERE rn = 1")
def w11_pick_first(spark, sf):
    d = t(spark, sf, "documents").select("source", "doc_id", "lang")
    return w.pick_first(d, ["source"], [F.col("doc_id") % 97 == 0, F.col("lang") == "de"], ["doc_id"]).drop("lang")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents WHERE n_chars > 100), e AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, doc_id FROM e JOIN d ON rn = dayofyear(day) % n")
def w12_daily_pick(spark, sf):
    days = t(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return w.daily_pick(t(spark, sf, "documents").where("n_chars > 100").select("doc_id"), "doc_id", days, "day").select("day", "doc_id")


# set operations

_KINDS = [("document", "documents", "doc_id", "text", 40), ("page", "pages", "page_id", "html", 10), ("item", "benchmark", "item_id", "text", 10)]


@query(" UNION ALL ".join(f"(SELECT '{k}' AS kind, CAST({i} AS VARCHAR) AS id, count(*) OVER () AS total, row_number() OVER (ORDER BY {i}) AS rank FROM {n} WHERE contains(lower({c}), 'with') ORDER BY {i} LIMIT {m})" for k, n, i, c, m in _KINDS))
def u1_search_all(spark, sf):
    return u.search_all({k: (t(spark, sf, n), i, c, m) for k, n, i, c, m in _KINDS}, "With")


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM documents WHERE text ILIKE '%zzzzzz%') THEN 'document' WHEN EXISTS (SELECT 1 FROM pages WHERE html ILIKE '%article%') THEN 'page' ELSE 'item' END AS kind")
def u2_leading_kind(spark, sf):
    d, p, b = (t(spark, sf, n) for n in ("documents", "pages", "benchmark"))
    totals = a.count_tables({"document": d.where("text ilike '%zzzzzz%'"), "page": p.where("html ilike '%article%'"), "item": b}).select(F.col("relation").alias("kind"), F.col("n").alias("total"))
    return u.leading_kind(totals, ["document", "page", "item"])


@query("SELECT doc_id, 'none' AS asked FROM documents UNION ALL SELECT doc_id, 'de' FROM documents WHERE lang = 'de'")
def u3_prefer_or_any(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    none, de = u.prefer_or_any(d, F.col("lang") == "nl"), u.prefer_or_any(d, F.col("lang") == "de")
    return none.select("doc_id", F.lit("none").alias("asked")).union(de.select("doc_id", F.lit("de").alias("asked")))


@query("""WITH h AS (SELECT event_type AS value, max(ts) AS ts FROM events WHERE event_type LIKE 'p%' GROUP BY 1 ORDER BY ts DESC, value LIMIT 3),
n AS (SELECT p_name AS value, min(p_partkey) AS ord FROM part WHERE lower(p_name) LIKE 'p%' AND p_name NOT IN (SELECT value FROM h) GROUP BY 1),
b AS (SELECT value, 0 AS kind, row_number() OVER (ORDER BY ts DESC, value) AS ord FROM h UNION ALL SELECT value, 1, ord FROM n)
SELECT value, row_number() OVER (ORDER BY kind, ord, value) AS place FROM (SELECT * FROM b ORDER BY kind, ord, value LIMIT 7)""")
def u4_suggest(spark, sf):
    history = t(spark, sf, "events").select(F.col("event_type").alias("value"), "ts")
    names = t(spark, sf, "part").select(F.col("p_name").alias("value"), F.col("p_partkey").alias("ord"))
    return u.suggest(history, names, "P")


@query("SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def u5_toggle_state(spark, sf):
    return u.toggle_state(t(spark, sf, "events"), ["user_id", "event_type"], "ts")


@query("SELECT event_id, user_id, event_type AS kind FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def u6_all_bookmarks(spark, sf):
    e = t(spark, sf, "events")
    return u.all_bookmarks({k: e.where(F.col("event_type") == k).select("event_id", "user_id") for k in ("click", "view", "purchase")})


@query("SELECT l_suppkey AS key FROM lineitem UNION SELECT s_suppkey + 1000000 FROM supplier")
def u7_distinct_keys(spark, sf):
    return u.distinct_keys([t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key")), t(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("key"))])


@query("SELECT doc_id FROM (SELECT doc_id, lang = 'de' AND n_chars < 300 AS whole, bool_or(lang = 'de' AND n_chars < 300) OVER (PARTITION BY source) AS any_whole FROM documents) WHERE whole = any_whole")
def u8_mode_rows(spark, sf):
    return u.mode_rows(t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), "source", (F.col("lang") == "de") & (F.col("n_chars") < 300)).select("doc_id")
