"""Streams with state of their own against their batch twins: several batches, late rows, a restart, and odd rows."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelight.streaming import feeds, stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "i bigint, client string, k string, ts timestamp"


def requests(n, seed=1):
    """In the order of time, some at the same time; a time to live of 300 s is over for some and not for others."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 30, 200])
        out.append((i, f"c{rng.randrange(3)}", rng.choice("abcde"), START + dt.timedelta(seconds=t, microseconds=rng.randrange(3))))
    return sorted(out, key=lambda r: (r[3], r[0]))


def parts(spark, rows, folder, cuts):
    """rows as files, one for each part, the older ones first."""
    for n, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/p{n}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/p*")


def hits(df):
    return {r.i: r.hit for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"client": "client", "most_keys": 3}])
def test_cache_stream_equals_the_batch_over_batches_and_a_restart(spark, tmp_path, options):
    rows = [r for r in requests(160) if r[0] != 80]
    cuts = [c for c in range(40, 140) if (rows[c][3] - rows[c - 1][3]).total_seconds() > 1][::30]
    want = hits(feeds.ttl_hits(spark.createDataFrame(rows, SCHEMA), "k", "ts", "i", 300, **options))
    assert 0.1 < sum(want.values()) / len(want) < 0.9
    parts(spark, rows[: cuts[1]], f"{tmp_path}/in", cuts[:1])
    cache = lambda: stateful.cache_stream(stream(spark, f"{tmp_path}/in"), "k", "ts", "i", 300, **options)
    first = hits(feeds.drain(cache(), f"{tmp_path}/state"))
    assert first and first.items() <= want.items() and len(first) <= cuts[1]
    spark.createDataFrame(rows[cuts[1] :], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/p9")
    assert hits(feeds.drain(cache(), f"{tmp_path}/state")) == want  # goes on where it stopped


def test_cache_stream_waits_for_rows_out_of_order(spark, tmp_path):
    rows = requests(120, seed=4)
    want = hits(feeds.ttl_hits(spark.createDataFrame(rows, SCHEMA), "k", "ts", "i", 300, client="client", most_keys=2))
    shuffled = [r for at in range(0, 120, 8) for r in rows[at : at + 8][::-1]]  # within about an hour
    closing = (999, "end", "z", START + dt.timedelta(days=9))
    parts(spark, [*shuffled, closing], f"{tmp_path}/in", [20, 45, 77, 120])
    got = hits(feeds.drain(stateful.cache_stream(stream(spark, f"{tmp_path}/in"), "k", "ts", "i", 300, client="client", most_keys=2, delay="2 hours")))
    assert got == want  # the closing request itself waits


def test_cache_stream_of_the_case_where_a_watermark_would_drop(spark, tmp_path):
    rows = [(h, "c", "k", START + dt.timedelta(hours=h)) for h in (0, 5, 9)]
    parts(spark, rows, f"{tmp_path}/in", [])
    assert hits(feeds.drain(stateful.cache_stream(stream(spark, f"{tmp_path}/in"), "k", "ts", "i"))) == {0: False, 5: False, 9: False}


def test_cache_stream_on_odd_rows(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, None, None, at(0)), (2, None, None, at(1)), (3, "c", None, at(2)), (4, "c", "", at(3)), (5, "c", "", at(4)), (6, "c", "x", None), (7, "c", "x", at(5)), (7, "c", "x", at(5))]
    df = spark.createDataFrame(rows, SCHEMA)
    parts(spark, rows, f"{tmp_path}/in", [])
    for options in ({}, {"client": "client"}):
        got = feeds.drain(stateful.cache_stream(stream(spark, f"{tmp_path}/in"), "k", "ts", "i", **options)).select("k", "i", "hit")
        want = feeds.ttl_hits(df, "k", "ts", "i", **options).select("k", "i", "hit")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_history_stream_equals_the_batch_after_each_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["u", "v", None]), rng.choice(["a", "A", "b", "B", "c", "d", "é", "É", None]), None if i == 7 else START + dt.timedelta(seconds=rng.randrange(60))) for i in range(90)]
    n = 0
    for upto in (30, 60, 90, 90):  # the last time nothing new is there
        if n < upto:
            spark.createDataFrame(rows[n:upto], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
        n = upto
        got = feeds.drain_updates(stateful.recent_stream(stream(spark, f"{tmp_path}/in"), "client", "k", "ts", 4), ["client", "place"], f"{tmp_path}/state")
        want = feeds.recent_distinct(spark.createDataFrame(rows[:n], SCHEMA), "client", "k", "ts", 4)
        columns = ["client", "k", F.col("ts").cast("string").alias("ts"), "place"]
        assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


class Store:
    """A state store that counts the values put into it."""

    def __init__(self):
        self.values, self.put_values = {}, 0

    def getValueState(self, name, schema):  # noqa: N802
        def update(value):
            self.values[name] = value
            self.put_values += 1

        return SimpleNamespace(get=lambda: self.values.get(name), update=update)

    def getListState(self, name, schema):  # noqa: N802
        def put(values):
            self.values[name] = values
            self.put_values += len(values)

        return SimpleNamespace(exists=lambda: name in self.values, get=lambda: iter(self.values.get(name, [])), put=put, clear=lambda: self.values.pop(name))

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timer = at


def test_waiting_requests_are_packed(monkeypatch):
    monkeypatch.setattr(stateful, "WAITING_AT_ONCE", 400)
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("client", "name", "order", "hit")])
    cache, store = stateful._Cache(out, 5_000_000, 3), Store()
    cache.init(store)
    rows = pd.DataFrame({"t": [n * 1_000_000 for n in range(1000)], "order": range(1000), "name": [n % 2 for n in range(1000)]})
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(cache.handleInputRows((1,), iter([rows]), now(-1))) == [] and store.put_values == 3 and store.timer == 0
    (some,) = cache.handleExpiredTimer((1,), now(499_000), None)
    (rest,) = cache.handleExpiredTimer((1,), now(10**9), None)
    assert (len(some), len(rest)) == (500, 500) and list(store.values) == ["kept"] and store.put_values == 3 + 2 + 2
    assert [*some["hit"], *rest["hit"]] == [n % 6 > 1 for n in range(1000)]
