"""Structured Streaming jobs: change feed, topics, presence, history, toggles and time-to-live dedup.

Streams are read from Parquet folders and drained with availableNow into Parquet in the shared checkpoint folder, so nothing passes through the
driver. The history (`recent_distinct`) and the cache (`ttl_hits`) are batch functions; their streaming twins, with equal rows, are in stateful.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import fold_groups
from ..sources.shared import Scratch, shared_folder


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream of files; timestamps without zone are read as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which processors of their own need."""
    name, on_disk = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, on_disk)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that an append-mode stream gives for what is there now. folder: where it was drained before, and goes on."""
    spark, once, folder = stream.sparkSession, folder is None, folder or shared_folder(stream.sparkSession)
    with _state_on_disk(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/offsets").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    if once:
        Scratch(spark).remove(f"{folder}/offsets")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_updates(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """The last row of each key that an update-mode stream gives for what is there now. folder: where it was drained before, and goes on."""
    spark, once, folder = stream.sparkSession, folder is None, folder or shared_folder(stream.sparkSession)
    rows = f"{folder}/rows"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{rows}/__batch=-1")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{rows}/__batch={batch}")  # a batch that is tried again replaces what it wrote

    with _state_on_disk(spark):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if once:
        Scratch(spark).remove(f"{folder}/offsets")
    w = Window.partitionBy(*keys).orderBy(F.col("__batch").desc())
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    return spark.read.schema(schema).parquet(rows).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__batch")


def change_feed(changes: DataFrame, event: str = "*", schema: str = "*", table: str = "*", where: Column | None = None) -> DataFrame:
    """(event_type, new, old, commit_timestamp) of the changes asked for.

    changes: (schema, table, type, commit_timestamp, record, old_record). INSERT has new, DELETE has old, UPDATE both.
    """
    wanted = [F.col(c) == v for c, v in (("type", event.upper()), ("schema", schema), ("table", table)) if v != "*"]
    for cond in [*wanted, *([where] if where is not None else [])]:
        changes = changes.where(cond)
    return changes.select(
        F.col("type").alias("event_type"),
        F.when(F.col("type") != "DELETE", F.col("record")).alias("new"),
        F.when(F.col("type") != "INSERT", F.col("old_record")).alias("old"),
        "commit_timestamp",
    )


def topic_events(events: DataFrame, topic_col: str, event_col: str, topic: str, event: str = "*") -> DataFrame:
    """Events of a topic by name, in any case; "*" is every name."""
    of_topic = events.where(F.col(topic_col) == topic)
    return of_topic if event == "*" else of_topic.where(F.lower(event_col) == event.lower())


def presence_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): connections that are new ("join") or gone ("leave")."""
    o, n = old.select(*keys).distinct().withColumn("__o", F.lit(True)), new.select(*keys).distinct().withColumn("__n", F.lit(True))
    both = o.join(n, keys, "full_outer").where("__o is null or __n is null")
    return both.select(*keys, F.when(F.col("__o").isNull(), "join").otherwise("leave").alias("change"))


def apply_presence(refs: list[str], pending: list[tuple], synced: bool, rows: list[tuple]) -> tuple[list[str], list[tuple], bool]:
    """One key's refs after (action, ref) rows in time order.

    Before the first sync, joins and leaves wait, and are replayed on top of it. A join appends a ref that is not there yet,
    a leave removes it. sync rows carry the whole list, comma-joined.
    """
    for action, ref in rows:
        if action == "sync":
            refs, synced = [r for r in ref.split(",") if r], True
            waiting, pending = pending, []
            refs, _, _ = apply_presence(refs, [], True, waiting)
        elif not synced:
            pending = [*pending, (action, ref)]
        elif action == "join":
            refs = refs if ref in refs else [*refs, ref]
        elif action == "leave":
            refs = [r for r in refs if r != ref]
    return refs, pending, synced


def presence_state(stream: DataFrame, key: str, ref: str, action: str, ts: str, synced: bool = True) -> DataFrame:
    """(key, refs) of each key touched, as a stream in update mode; keys without refs have an empty string. synced=False: wait for a sync row."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ref).cast("string").alias("ref"), F.col(action).alias("action"), F.col(ts).alias("ts"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        refs, pending, seen = state.get if state.exists else ("", "", synced)
        got = pd.concat(list(batches)).sort_values(["ts", "ref"], kind="stable")
        waiting = [tuple(x.split("\t")) for x in pending.split("\n") if x]
        new, waiting, seen = apply_presence([r for r in refs.split(",") if r], waiting, seen, list(zip(got.action, got.ref, strict=True)))
        state.update((",".join(new), "\n".join("\t".join(x) for x in waiting), seen))
        yield pd.DataFrame({"key": [k[0]], "refs": [",".join(new)]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, refs string", "refs string, pending string, synced boolean", "update", GroupStateTimeout.NoTimeout)


def recent_distinct(events: DataFrame, user: str, value: str, ts: str, n: int) -> DataFrame:
    """(user, value, ts, place): each user's last n different values, newest first; case does not count."""
    last = events.groupBy(user, F.lower(value).alias("__l")).agg(F.max(F.struct(ts, value)).alias("m"))
    rows = last.select(user, F.col(f"m.{value}").alias(value), F.col(f"m.{ts}").alias(ts), "__l")
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), "__l")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("__l")


def toggle_stream(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys, n, ts) in update mode: toggles so far; an odd number means on."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ts"))


def ttl_dedup(stream: DataFrame, keys: list[str], ts: str, ttl: str = "300 seconds") -> DataFrame:
    """The stream with one row of each key until the watermark, which is the time to live behind, has passed that row: native, with state as small as the keys.

    That is not the cache's rule, by which a key is new again at once when its time is over: `stateful.cache_stream` has that.
    """
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def ttl_hits(events: DataFrame, key: str, ts: str, order: str, seconds: int = 300, client: str | None = None, most_keys: int = 50) -> DataFrame:
    """Batch: (key, order, hit) of each request: whether the cache served it. A hit does not refresh the entry's time.

    client: whose cache it is, which holds most_keys entries and then loses the one that was put in first; without, every key's entry is kept.
    """
    ttl = seconds * 1_000_000

    def bounded(kept: tuple, k: object, t: int | None) -> tuple[tuple, bool]:
        own = next((at for name, at in kept if name == k), None)
        if own is not None and t is not None and t - own < ttl:
            return kept, True
        return (*(e for e in kept if e[0] != k), (k, t))[-most_keys:], False

    def step(kept: int | None, t: int | None) -> tuple[int | None, bool]:
        hit = kept is not None and t is not None and t - kept < ttl
        return (kept, True) if hit else (t, False)

    if client is not None:
        rows = events.select(client, key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
        return fold_groups(rows, [client], ["__t", order], [key, "__t"], (), bounded, "hit", T.BooleanType()).select(key, order, "hit")
    rows = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    return fold_groups(rows, [key], ["__t", order], ["__t"], None, step, "hit", T.BooleanType()).select(key, order, "hit")
