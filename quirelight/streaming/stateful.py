"""Streams whose state is their own: the result cache and the recent history, each with the same rows as its batch twin in feeds.

State lies in the state store's values and lists, per client or user, and is bounded: most_keys cache entries and the requests that still wait for their
time, or n history entries. The cache's are packed, many to a value, since each value is a message of its own between Python and the store. A batch that is tried again starts from the state before it, so that nothing counts twice.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WAITING_AT_ONCE = 10_000


class _Cache(StatefulProcessor):
    """One client's cache. Requests wait until the watermark has reached their time, and are then served in the order of time."""

    def __init__(self, out: T.StructType, ttl: int, most_keys: int):
        self.out, self.ttl, self.most_keys = out, ttl, most_keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = T.StructType([T.StructField("packed", T.BinaryType())])
        self.kept = handle.getValueState("kept", packed)  # [(name, t)] in the order in which they were put
        self.waiting = handle.getListState("waiting", packed)  # each value has up to WAITING_AT_ONCE requests

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for pdf in rows for r in zip(pdf["t"].tolist(), _plain(pdf["order"]), _plain(pdf["name"]), strict=True)]
        return self._serve(key, new, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return self._serve(key, [], timerValues)

    def _serve(self, key: tuple, new: list[tuple], timers: object) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        before = [r for (packed,) in self.waiting.get() for r in pickle.loads(packed)]
        requests = [*before, *new]
        later = [r for r in requests if r[0] > now]
        due = sorted((r for r in requests if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0))
        if later:
            self.waiting.put([(pickle.dumps(later[at : at + WAITING_AT_ONCE]),) for at in range(0, len(later), WAITING_AT_ONCE)])
            self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
        elif before:
            self.waiting.clear()
        if due:
            yield self._answers(key, due)

    def _answers(self, key: tuple, due: list[tuple]) -> pd.DataFrame:
        held = self.kept.get()
        entries, hits = dict(pickle.loads(held[0])) if held else {}, []
        for t, _, name in due:
            hit = name in entries and t - entries[name] < self.ttl
            hits.append(hit)
            if not hit:
                entries.pop(name, None)
                entries[name] = t
                if len(entries) > self.most_keys:
                    del entries[next(iter(entries))]
        if not all(hits):
            self.kept.update((pickle.dumps(list(entries.items())),))
        columns = [[key[0]] * len(due), [r[2] for r in due], [r[1] for r in due], hits]
        return pd.DataFrame({f.name: pd.Series(c, dtype=object) for f, c in zip(self.out, columns, strict=True)})

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """Python values; None for missing ones, which pandas may hold as NaN."""
    if not column.hasnans:
        return column.tolist()
    kept = column.astype(object)
    return kept.where(column.notna(), None).tolist()


def cache_stream(stream: DataFrame, key: str, ts: str, order: str, seconds: int = 300, client: str | None = None, most_keys: int = 50, delay: str = "0 seconds") -> DataFrame:
    """(client, key, order, hit) of each request, in append mode: the rows of feeds.ttl_hits, as time goes on.

    A request is answered when the watermark, `delay` behind the newest request, reaches its time: so requests that come out of order within the delay are served in order.
    Those that come later than that are dropped by Spark, and those without a time are no hits and are not kept. Without a client, each key is a cache of its own. What waits for one
    client is held by one task.
    """
    kinds = stream.schema
    upper = F.timestamp_millis(F.ceil(F.unix_micros(F.col(ts)) / 1000).cast("long"))  # watermarks are whole milliseconds, and so reach the newest request
    rows = stream.select(F.col(client or key).alias("client"), F.col(key).alias("name"), F.col(order).alias("order"), upper.alias("ts"), F.unix_micros(F.col(ts)).alias("t"))
    named = zip(("client", "name", "order"), (client or key, key, order), strict=True)
    out = T.StructType([*[T.StructField(n, kinds[c].dataType) for n, c in named], T.StructField("hit", T.BooleanType())])
    timed = rows.where("ts is not null").withWatermark("ts", delay).groupBy("client")
    served = timed.transformWithStateInPandas(_Cache(out, seconds * 1_000_000, most_keys if client else 1), out, "append", "EventTime")
    both = served.union(rows.where("ts is null").select("client", "name", "order", F.lit(False).alias("hit")))
    return both.select(*([F.col("client").alias(client)] if client else []), F.col("name").alias(key), F.col("order").alias(order), "hit")


class _Recent(StatefulProcessor):
    """One user's last n values. An entry that was pushed out had n newer ones, and so can't come back but by a newer row: the list is enough, in whatever order rows come."""

    def __init__(self, state: T.StructType, n: int):
        self.state, self.n = state, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rank = lambda x: (x is not None, x if x is not None else 0)
        text = lambda x: (x is not None, x or "")
        last = {low: (t, value) for low, t, value in self.recent.get()} if self.recent.exists() else {}
        for pdf in rows:
            for low, t, value in zip(_plain(pdf["low"]), _plain(pdf["t"]), _plain(pdf["value"]), strict=True):
                t = None if t is None else int(t)
                if low not in last or (rank(t), text(value)) > (rank(last[low][0]), text(last[low][1])):
                    last[low] = (t, value)
            by_name = sorted(last.items(), key=lambda e: text(e[0]))
            last = dict(sorted(by_name, key=lambda e: rank(e[1][0]), reverse=True)[: self.n])
        self.recent.put([(low, t, value) for low, (t, value) in last.items()])
        found = list(last.values())
        columns = {"user": [key[0]] * len(found), "value": [v for _, v in found], "t": [t for t, _ in found], "place": list(range(1, len(found) + 1))}
        yield pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in columns.items()})

    def close(self) -> None:
        pass


def recent_stream(stream: DataFrame, user: str, value: str, ts: str, n: int) -> DataFrame:
    """(user, value, ts, place) in update mode: after each batch, the whole list of each user who did something in it, as feeds.recent_distinct has it."""
    rows = stream.select(F.col(user).alias("user"), F.lower(value).alias("low"), F.unix_micros(F.col(ts)).alias("t"), F.col(value).alias("value"))
    state = T.StructType([rows.schema[c] for c in ("low", "t", "value")])
    out = T.StructType([rows.schema["user"], rows.schema["value"], rows.schema["t"], T.StructField("place", T.IntegerType())])
    kept = rows.groupBy("user").transformWithStateInPandas(_Recent(state, n), out, "update", "None")
    return kept.select(F.col("user").alias(user), F.col("value").alias(value), F.timestamp_micros("t").alias(ts), "place")
