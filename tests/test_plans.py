"""Plans: what reaches the scan, and what must not be in them."""

import contextlib
import io
import re

import pytest

from quirelight.plans import corpus_queries


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(corpus_queries.QUERIES["f3_comparisons"](spark, sf_dir))
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "LessThan(o_custkey,1000)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"o_orderkey", "o_custkey", "o_totalprice"}


@pytest.mark.parametrize("name", ["f1_eq", "f5_like_many", "t3_snippet", "t4_clean_text", "t9_format_ref", "w8_pack_lines", "tx6_text_search"])
def test_text_and_filter_plans_stay_in_the_jvm(name, spark, sf_dir):
    assert not re.search("Python|Pandas|Arrow", plan_of(corpus_queries.QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["t3_snippet", "t4_clean_text", "f5_like_many", "tx7_paragraphs", "w8_pack_lines"])
def test_row_functions_do_not_shuffle(name, spark, sf_dir):
    assert "Exchange" not in plan_of(corpus_queries.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["s7_top_k", "s4_page", "j12_neighbours"])
def test_limits_are_taken_before_rows_move(name, spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(corpus_queries.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["w1_dedup_prefer", "w3_top_n_per_group", "a12_first_distinct"])
def test_ranks_cut_groups_before_the_shuffle(name, spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(corpus_queries.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", [n for n in sorted(corpus_queries.QUERIES) if re.match(r"j\d|tx[123]_", n)])
def test_joins_have_keys(name, spark, sf_dir):
    plan = plan_of(corpus_queries.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
