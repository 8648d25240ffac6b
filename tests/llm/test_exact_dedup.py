"""Exact duplicates: codes, collisions, hot groups and odd rows."""

import contextlib
import io
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.llm import exact_dedup
from quirelight.llm.common import Scratch

from .test_operators import ODD


def brute(rows):
    """rows: (doc_id, text); the multiset of results, without digests."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), nth == 0) for nth, m in enumerate(members)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 45), max_size=80), st.integers(0, 45))
def test_codes_are_read_back(values, k):
    v = np.array(sorted(values), np.int64)
    if (np.diff(v, prepend=-1) >> k).sum() < 1 << 22:
        assert (exact_dedup.decode(exact_dedup.encode(v, k), len(v), k) == v).all()


def test_code_is_near_the_least_size():
    n, among = 60_000, 1 << 42
    v = np.sort(np.random.default_rng(1).integers(0, among, n))
    v = np.unique(v)
    bits = 8 * len(exact_dedup.encode(v, exact_dedup.golomb_bits(len(v), among))) / len(v)
    assert bits < np.log2(among / n) + 1.7


def texts(n, seed):
    """Rows with a hot text, small groups that differ in white space, and single ones."""
    rng = random.Random(seed)
    rows = [(i, "the same hot text" if i % 3 == 0 else f"text {rng.randrange(n // 2)} of many") for i in range(n)]
    return [(i, t.replace(" ", rng.choice([" ", "  ", "\t", ""]))) for i, t in rows]


@pytest.mark.parametrize("extra_bits", [8, -4, -30])
def test_equals_brute_force_however_short_fingerprints_are(spark, extra_bits):
    rows = texts(3000, extra_bits)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert result(exact_dedup.deduplicate(df, extra_bits=extra_bits)) == brute(rows)


def test_several_chunks_in_a_task(spark, monkeypatch):
    rows = [(i, f"t {i % 40_000}") for i in range(140_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert result(exact_dedup.deduplicate(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(i, t) for i, t, _, _ in ODD] + [(None, None), (None, None), (9, "one  two\nthree"), (10, "one two three")]
    df = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id bigint, text string, norm string, row int, suspect boolean").repartition(3)
    assert result(exact_dedup.deduplicate(df)) == brute(rows)
    assert exact_dedup.deduplicate(df.limit(0)).collect() == []


def test_only_suspects_leave_their_bucket(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS exact_dedup_plan")
    held = spark.range(100).selectExpr("id as row", "id as f", "0L as chunk", "'x' as norm")
    held.write.bucketBy(4, "chunk").option("path", str(tmp_path / "t")).saveAsTable("exact_dedup_plan")
    scratch = Scratch(spark)
    marks = scratch.keep(exact_dedup.suspect_marks(spark.table("exact_dedup_plan"), 20, 2, scratch)).hint("shuffle_hash")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        spark.table("exact_dedup_plan").join(marks, "chunk", "left").explain()
    plan = out.getvalue()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and re.search(r"Exchange[^\n]*\n[^\n]*Filter[^\n]*\n[^\n]*FileScan[^\n]*marks", plan)
    spark.sql("DROP TABLE exact_dedup_plan")
