"""Sources, sinks, filters and orders over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import ordering as s
from ..sources import tables as io
from .registry import query
from .registry import table as t

# sources and sinks


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src1_scan(spark, sf):
    return io.scan(spark, f"{sf}/orders.parquet", ["o_orderkey", " o_custkey ", "o_totalprice"])


@query("SELECT n_name, n_regionkey FROM nation")
def src2_scan_table(spark, sf):
    t(spark, sf, "nation").createOrReplaceTempView("corpus_nation")
    return io.scan_table(spark, "corpus_nation", ["n_name", "n_regionkey"])


@query()
def src3_list_objects(spark, sf):
    return io.list_objects(spark, sf, prefix="p").select("name", "length")


@query("""SELECT event_id, user_id, value, event_type, value > 50 AS flag, CAST(ts AS DATE) AS day, [user_id, event_id][1] AS first_id FROM events""")
def src4_decode_columns(spark, sf):
    e = t(spark, sf, "events")
    wire = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.col("value").cast("string").alias("value"), "event_type",
        F.when(F.col("value") > 50, "t").when(F.col("value").isNotNull(), "f").alias("flag"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.format_string("{%d,%d}", "user_id", "event_id").alias("ids"),
    )
    d = io.decode_columns(wire, {"event_id": "int8", "user_id": "int8", "value": "float8", "event_type": "text", "flag": "bool", "day": "date", "ids": "_int8"})
    return d.select("event_id", "user_id", "value", "event_type", "flag", "day", F.col("ids")[0].alias("first_id"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END, -1) AS k FROM events")
def src5_read_json(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, '{"k": ').when(F.col("event_id") % 7 == 0, None).otherwise(F.col("props")).alias("props"))
    d = io.read_json_column(e, "props", "k bigint", F.struct(F.lit(-1).cast("long").alias("k")))
    return d.select("event_id", "props.k")


@query("""SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS json FROM events""")
def src6_write_json(spark, sf):
    return io.to_json_column(t(spark, sf, "events"), ["user_id", "event_type"]).select("event_id", "json")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'new ' || c_name, NULL, NULL, 'UNKNOWN' FROM customer WHERE c_custkey % 10 = 0")
def snk1_append(spark, sf):
    c = t(spark, sf, "customer")
    new = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"))
    return io.append_rows(c, new, {"c_mktsegment": "UNKNOWN"})


def _changed(spark, sf):
    c = t(spark, sf, "customer")
    return c, c.where("c_custkey % 10 = 0").withColumn("c_custkey", F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 5000000)).withColumn("c_name", F.lit("changed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 5000000, 'changed' FROM customer WHERE c_custkey % 20 = 10")
def snk2_upsert_merge(spark, sf):
    return io.upsert(*_changed(spark, sf), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 5000000, 'changed' FROM customer WHERE c_custkey % 20 = 10")
def snk2_upsert_ignore(spark, sf):
    return io.upsert(*_changed(spark, sf), ["c_custkey"], ignore=True).select("c_custkey", "c_name")


def _patches(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d, d.where("n_chars < 300").select("doc_id", F.lit("xx").alias("lang"), F.when(F.col("n_chars") < 100, "short").alias("source"))


@query("SELECT doc_id, CASE WHEN n_chars < 300 THEN 'xx' ELSE lang END AS lang, CASE WHEN n_chars < 100 THEN 'short' ELSE source END AS source, n_chars FROM documents")
def snk3_patch(spark, sf):
    d, p = _patches(spark, sf)
    return io.patch(d, p, ["doc_id"], ["lang", "source"])


@query("SELECT doc_id, lang AS old_lang, 'xx' AS new_lang, source AS old_source, CASE WHEN n_chars < 100 THEN 'short' ELSE source END AS new_source FROM documents WHERE n_chars < 300")
def snk7_patch_dry_run(spark, sf):
    d, p = _patches(spark, sf)
    return io.patch(d, p, ["doc_id"], ["lang", "source"], dry_run=True)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def snk4_delete_where(spark, sf):
    return io.delete_where(t(spark, sf, "customer"), F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def snk4_delete_keys(spark, sf):
    gone = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return io.delete_keys(t(spark, sf, "customer").select("c_custkey"), gone, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def snk5_max_affected(spark, sf):
    return io.max_affected(t(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey"), 10**9)


@query("SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS csv FROM nation")
def snk6_csv(spark, sf):
    return io.csv_column(t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


# filters

_O = "SELECT o_orderkey FROM orders WHERE "


def _orders(spark, sf, cond):
    return t(spark, sf, "orders").where(cond).select("o_orderkey")


@query(_O + "o_orderstatus = 'F'")
def f1_eq(spark, sf):
    return _orders(spark, sf, f.where_op("o_orderstatus", "eq", "F"))


@query("SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) WHERE s <> 'F'")
def f2_neq(spark, sf):
    o = t(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return o.where(f.where_op("s", "neq", "F")).select("o_orderkey")


@query(_O + "o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderkey >= 10 AND o_custkey < 1000")
def f3_comparisons(spark, sf):
    return _orders(spark, sf, f.where_op("o_totalprice", "gt", 1000) & f.where_op("o_totalprice", "lte", 200000) & f.where_op("o_orderkey", "gte", 10) & f.where_op("o_custkey", "lt", 1000))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%STEEL%' OR p_name ILIKE 'PART%1'")
def f4_like(spark, sf):
    return t(spark, sf, "part").where(f.where_op("p_name", "like", "%a%") & f.where_op("p_type", "ilike", "%steel%") | f.where_op("p_name", "ilike", "PART%1")).select("p_partkey")


@query("SELECT p_partkey, (p_name LIKE '%1%' AND p_name LIKE '%2%') AS all_of, (p_name LIKE '%1%' OR p_name LIKE '%2%') AS any_of, (p_brand ILIKE 'BRAND%' AND p_brand ILIKE '%1') AS iall_of, (p_brand ILIKE '%x' OR p_brand ILIKE 'b%2') AS iany_of FROM part")
def f5_like_many(spark, sf):
    n, b = F.col("p_name"), F.col("p_brand")
    return t(spark, sf, "part").select("p_partkey", f.like_all(n, ["%1%", "%2%"]).alias("all_of"), f.like_any(n, ["%1%", "%2%"]).alias("any_of"), f.ilike_all(b, ["BRAND%", "%1"]).alias("iall_of"), f.ilike_any(b, ["%x", "b%2"]).alias("iany_of"))


@query("SELECT doc_id, regexp_matches(text, 'th[ae]re?') AS cs, regexp_matches(text, '(?i)LICEN[CS]E') AS ci FROM documents")
def f6_regex(spark, sf):
    return t(spark, sf, "documents").select("doc_id", f.matches(F.col("text"), "th[ae]re?").alias("cs"), f.matches(F.col("text"), "LICEN[CS]E", True).alias("ci"))


@query("SELECT c_custkey, b IS NULL AS is_null, b IS NOT DISTINCT FROM true AS is_true, b IS NOT DISTINCT FROM false AS is_false FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal > 0 END AS b FROM customer)")
def f7_is(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") > 0).alias("b"))
    return c.select("c_custkey", f.is_(F.col("b"), None).alias("is_null"), f.is_(F.col("b"), True).alias("is_true"), f.is_(F.col("b"), False).alias("is_false"))


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END) IS DISTINCT FROM 'BUILDING'")
def f8_is_distinct(spark, sf):
    return t(spark, sf, "customer").where(f.is_distinct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")), "BUILDING")).select("c_custkey")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS is_in, o_orderpriority NOT IN ('1-URGENT', '5-LOW') AS not_in FROM orders")
def f9_in(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", f.in_list(F.col("o_orderstatus"), ["F", "O", "F"]).alias("is_in"), f.not_in_list(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]).alias("not_in"))


@query("SELECT doc_id, list_has_all(string_split(lower(text), ' '), ['the', 'of']) AS cs, list_has_all(['en', 'de', 'src0', 'src1'], [lang, source]) AS cd FROM documents")
def f10_array_containment(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", f.contains_all(F.split(F.lower("text"), " "), ["the", "of"]).alias("cs"), f.contained_by(F.array("lang", "source"), ["en", "de", "src0", "src1"]).alias("cd"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def f11_json_containment(spark, sf):
    return t(spark, sf, "events").where(f.json_contains(F.col("props"), {"k": 7})).select("event_id")


@query("SELECT a.l_orderkey, lo, hi, (lo <= 4 AND 3 <= hi) AS ov, lo > 4 AS sr, hi < 3 AS sl, lo >= 3 AS nxl, hi <= 4 AS nxr, (hi + 1 = 3 OR 4 + 1 = lo) AS adj FROM (SELECT l_orderkey, min(l_linenumber) AS lo, least(max(l_linenumber), 2 + l_orderkey % 5) AS hi FROM lineitem GROUP BY l_orderkey) a")
def f12_f13_ranges(spark, sf):
    r = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.least(F.max("l_linenumber"), 2 + F.col("l_orderkey") % 5).alias("hi"))
    lo, hi, a, b = F.col("lo"), F.col("hi"), F.lit(3), F.lit(4)
    return r.select("l_orderkey", "lo", "hi", f.ranges_overlap(lo, hi, a, b).alias("ov"), f.range_right_of(lo, b).alias("sr"), f.range_left_of(hi, a).alias("sl"), f.range_not_left(lo, a).alias("nxl"), f.range_not_right(hi, b).alias("nxr"), f.ranges_adjacent(lo, hi, a, b).alias("adj"))


@query(_O + "o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def f14_match(spark, sf):
    return f.match(t(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "2-HIGH"}).select("o_orderkey")


@query(_O + "NOT o_orderstatus = 'O' OR o_totalprice > 300000 OR o_orderpriority IN ('1-URGENT')")
def f15_not_or_generic(spark, sf):
    return _orders(spark, sf, f.any_of([f.where_op("o_orderstatus", "not.eq", "O"), f.where_op("o_totalprice", "gt", 300000), f.where_op("o_orderpriority", "in", ["1-URGENT"])]))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 100")
def f16_nonblank(spark, sf):
    return t(spark, sf, "documents").where(f.nonblank(F.col("text"), 100)).select("doc_id")


@query(_O + "false")
def f17_no_rows(spark, sf):
    return f.no_rows(t(spark, sf, "orders")).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 50")
def f18_grep(spark, sf):
    return f.grep(t(spark, sf, "documents"), "text", "LICENSE", "doc_id", 50).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000012')")
def f19_grep_names(spark, sf):
    return f.grep(t(spark, sf, "customer"), "c_name", "#00000012", "c_name", None).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents WHERE upper(substr(trim(text), 1, 200)) <> '' AND NOT starts_with(upper(substr(trim(text), 1, 200)), 'THE') AND NOT starts_with(upper(substr(trim(text), 1, 200)), 'AND ')")
def f20_drop_front_matter(spark, sf):
    return t(spark, sf, "documents").where(f.not_front_matter(F.col("text"), ["THE", "AND "])).select("doc_id")


@query(_O + "o_orderstatus = 'P'")
def f21_optional_eq(spark, sf):
    o = f.optional_eq(t(spark, sf, "orders"), "o_orderstatus", "P")
    return f.optional_eq(o, "o_orderpriority", "all").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_linenumber BETWEEN 2 AND 3 AS highlight FROM lineitem")
def f22_flag_range(spark, sf):
    return f.flag_range(t(spark, sf, "lineitem"), "l_linenumber", 2, 3).select("l_orderkey", "l_linenumber", "highlight")


# orders


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders")
def s1_order(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    return s.order(o, [("price", False, "last"), ("o_orderkey", True, None)])


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), ',') AS keys, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3], ',') AS first FROM orders GROUP BY o_custkey")
def s2_s3_embedded(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(s.order_embedded(rows, "o_totalprice", True).alias("r"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["o_orderkey"].cast("string")), ",")
    return o.select("o_custkey", text("r").alias("keys"), text(s.limit_embedded(F.col("r"), 3)).alias("first"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def s4_page(spark, sf):
    return s.page(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 149)


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 20")
def s5_search_page(spark, sf):
    return s.search_page(t(spark, sf, "documents"), F.col("lang") == "en", ["doc_id"], 20, 39).select("doc_id", "total")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def s6_single(spark, sf):
    return s.single(t(spark, sf, "nation").where("n_nationkey = 7")).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = -1")
def s6_maybe_single(spark, sf):
    return s.maybe_single(t(spark, sf, "nation").where("n_nationkey = -1")).select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 20")
def s7_top_k(spark, sf):
    return s.top_k(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 20, ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey FROM customer ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 9999 ELSE c_acctbal END, c_custkey")
def s8_order_with_default(spark, sf):
    c = t(spark, sf, "customer").withColumn("b", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return s.order_with_default(c, "b", 9999.0, ["c_custkey"]).select("c_custkey")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id")
def s9_recent(spark, sf):
    return s.recent(t(spark, sf, "events"), "ts", ["event_id"]).select("event_id", "user_id")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber")
def s10_canonical_order(spark, sf):
    return s.canonical_order(t(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber")
