"""Operators on groups that hold most rows: the same rows as over whole groups, and plans in which no task must hold a group."""

import contextlib
import io
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelight.functions import structure, text, udfs
from quirelight.operators import aggregates, joins, windows


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*(cols or df.columns)).collect())))


def units(rng, n, span):
    """Two thirds in one group; positions of any sign, some twice, some missing."""
    return [(rng.choice(["hot", "hot", "a"]) if i % 50 else None, None if i % 41 == 0 else rng.randrange(-span, span), i) for i in range(n)]


@pytest.mark.parametrize("span", [60, 5_000, 40_000_000])
def test_range_join_by_bins(spark, span):
    rng = random.Random(span)
    u = units(rng, 300, span)
    refs = [(rng.choice(["hot", "a", "none", None]), lo, None if i % 30 == 0 or lo is None else lo + rng.choice([-1, 0, 3, 100, span // 2, 2**40]), i) for i in range(120) for lo in [rng.choice([rng.randrange(-2 * span, 2 * span), None, -(2**50)])]]
    got = joins.range_join(spark.createDataFrame(refs, "g string, lo bigint, hi bigint, r int"), spark.createDataFrame(u, "g string, p bigint, i int"), ["g"], "lo", "hi", "p")
    assert got.columns == ["g", "lo", "hi", "r", "p", "i"]
    want = [(g, lo, hi, r, p, i) for g, lo, hi, r in refs for h, p, i in u if g is not None and g == h and None not in (lo, hi, p) and lo <= p <= hi]
    assert rows(got) == sorted(map(repr, want)) and want


@pytest.mark.parametrize("width", [4, 1 << 12])
def test_overlap_by_a_sweep(spark, width):
    rng = random.Random(width)
    passages = [(g, s, e, rng.choice([g, "a"])) for _ in range(300) for g in [rng.choice(["hot", "hot", "a", None])] for s in [rng.choice([None, *range(-30, 60)])] for e in [rng.choice([None, (s or 0) + rng.randrange(-3, 25)])]]
    selected = [(rng.choice(["hot", "a", None]), rng.choice([None, *range(-20, 70, 9)])) for _ in range(14)]
    df = spark.createDataFrame(passages, "g string, s int, e int, eg string")
    got = joins.interval_overlap(df, spark.createDataFrame(selected, "g string, pos int"), "g", "s", "e", "eg", "pos", width)
    hi = lambda g, s, e, eg: e if e is not None and eg == g and s is not None and e >= s else s
    want = [p for p in passages if p[0] is not None and p[1] is not None and any(g == p[0] and q is not None and p[1] <= q <= hi(*p) for g, q in selected)]
    assert rows(got) == sorted(map(repr, want)) and 20 < len(want) < 280


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_runs_and_neighbours_over_stretches(spark, width):
    rng = random.Random(width)
    marks = [(rng.choice(["hot", "hot", "a", None]), i if i % 40 else None, rng.choice(["x", "x", "x", "y", None]), i) for i in range(-100, 140)]
    marks += [("long", i, "same", i) for i in range(40)]
    df = spark.createDataFrame(marks, "p string, o int, k string, i int").repartition(4)
    got = windows.runs(df, "p", ["o", "i"], "k", width)
    want = []
    for p in {m[0] for m in marks}:
        run, last = 0, object()
        mine = sorted((m for m in marks if m[0] == p), key=lambda m: (m[1] is not None, m[1] or 0, m[3]))
        for _, o, k, _ in mine:
            if k != last or not run:
                run, last = run + 1, k
                want.append([p, run, k, 0, None, None])
            r = want[-1]
            r[3] += 1
            r[4], r[5] = o if r[4] is None else r[4], o if o is not None else r[5]
    assert rows(got) == sorted(repr(tuple(r)) for r in want)
    near = windows.neighbours_in_group(df.where("o is not null").select("p", "o"), "p", "o", width)
    want = []
    for p in {m[0] for m in marks}:
        mine = sorted(m[1] for m in marks if m[0] == p and m[1] is not None)
        want += [(p, o, mine[n - 1] if n else None, mine[n + 1] if n + 1 < len(mine) else None) for n, o in enumerate(mine)]
    assert rows(near) == sorted(map(repr, want))
    for plan in (plan_of(got), plan_of(near)):
        for window in re.findall(r"Window \[.*\], \[([^\]]*)\], \[", plan):
            assert "," in window or "__c" in plan or "__b" in plan
        assert not re.search(r"hashpartitioning\((p|part)#\d+, \d+\)", re.sub(r"hashpartitioning\(__[gp]#\d+, \d+\)", "", plan))


def test_completion_ranks_before_rows_move(spark):
    names = [(f"naam {i % 30}", i) for i in range(300)] + [("noot", 5), ("Noord", 4)]
    aliases = [(9, "nd", "Noord"), (8, "na", "naam 3"), (7, None, "leeg")]
    typed = spark.createDataFrame([("n",), ("NAAM",), (" no ",), ("n",), ("x",), ("na 3:1",), (None,), ("",)], "q string")
    got = structure.complete(typed, "q", spark.createDataFrame(names, "name string, ord int"), spark.createDataFrame(aliases, "ord int, alias string, name string"), 4)
    found = {}
    for r in got.collect():
        found.setdefault(r.q, {})[r.place] = r.value
    assert {q: [v[i] for i in range(len(v))] for q, v in found.items()} == {"n": ["naam 0", "naam 1", "naam 2", "naam 3"], "NAAM": ["naam 0", "naam 1", "naam 2", "naam 3"], " no ": ["Noord", "noot"]}
    plan = plan_of(got)
    assert "WindowGroupLimit" in plan and "collect_list" not in plan


def test_estimated_counts_open_some_files_only(spark, tmp_path):
    spark.range(0, 50_000, 1, 100).select("id", (F.col("id") % 7).alias("k")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("k = 3")
    n, bound = aggregates.estimated_count(df, 0.3).first()
    assert abs(n - df.count()) <= bound < 0.2 * n
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan that ran can be asked
    try:
        counted = aggregates.estimated_count(df, 0.3)
        counted.collect()
        scan = counted._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numFiles").value() == 30
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert aggregates.estimated_count(spark.read.parquet(f"{tmp_path}/t").where("k = 9"), 0.3).first() == (0, 0)
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert aggregates.estimated_count(spark.read.parquet(f"{tmp_path}/one").where("id > 3")).first() == (6, 0)


def test_fold_is_that_of_python_on_the_basic_plane(spark):
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000)) if unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in points], "t string").select("t", text.fold(F.col("t")).alias("a"), udfs.fold_all("t").alias("b"))
    strays = [r.t for r in df.where("a <> b").collect()]
    assert not strays, strays  # letters that this Python's Unicode knows


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("aÉǖệ가힣がپΆϊ̈́ ǅßĳ😀i", max_size=12), min_size=1, max_size=8))
def test_fold_of_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.fold(F.col("t")).alias("a"), udfs.fold_all("t").alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_rules_that_look_back_change_the_same_texts(spark):
    rules = [("(^|[^A-Za-zÀ-ÿ])[Rr]e([^A-Za-zÀ-ÿ]|$)", "$1RE$2"), ("(^|[^A-Za-zÀ-ÿ])of ([A-Za-zÀ-ÿ])", "$1OF-$2"), ("(^|[^a])[ab]b(c|$)", "$1X$2")]
    rng = random.Random(5)
    df = spark.createDataFrame([("".join(rng.choices(["re", "Re", "of ", " ", "é", "\n", "😀", "a", "b", "c", "1"], k=rng.randrange(12))),) for _ in range(4000)] + [(None,)], "t string")
    for rule in rules:
        assert text._looking_back(rule) != rule
        got = df.select("t", text.apply_rules(F.col("t"), [rule]).alias("a"), F.regexp_replace("t", F.lit(rule[0]), F.lit(rule[1])).alias("b"))
        assert got.where("not a <=> b").collect() == [] and got.where("a <> t").count() > 30
    for kept in [("([0-9]+)[.]([0-9]+)", "$1:$2"), ("(^|[^a])b+", "$1x"), ("(^|[^a])b|c", "$1x"), ("(^|[^a])b", "x"), ("(^|[^a])b", "$1$1"), ("(^|[^a])b(c)\\1", "$1x")]:
        assert text._looking_back(kept) == kept
