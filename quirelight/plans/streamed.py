"""Streaming jobs over the events table, drained into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, setops
from ..streaming import feeds, stateful
from .registry import SQL, query
from .registry import table as t

_PRESENCE = {"signup": "join", "click": "join", "error": "leave"}


def _changes(events):
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    row = lambda v: F.struct(F.col("user_id").alias("user_id"), v.alias("value"))
    return events.select(
        F.lit("public").alias("schema"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("table"), kind.alias("type"), F.col("ts").alias("commit_timestamp"),
        row(F.col("value")).alias("record"), row(F.col("value") - 1).alias("old_record"), "event_id",
    )


@query("SELECT CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event_type, CASE WHEN event_type <> 'error' THEN user_id END AS new_user, CASE WHEN event_type <> 'signup' THEN user_id END AS old_user, count(*) AS n FROM events WHERE event_id % 2 = 0 AND user_id > 10 GROUP BY 1, 2, 3")
def st1_change_feed(spark, sf):
    changes = _changes(feeds.read_stream(spark, sf, "events"))
    rows = feeds.drain(feeds.change_feed(changes, table="even", where=F.col("record.user_id") > 10))
    return rows.groupBy("event_type", F.col("new.user_id").alias("new_user"), F.col("old.user_id").alias("old_user")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE user_id % 5 = 0 AND lower(event_type) = 'click'")
def st2_topic_events(spark, sf):
    events = feeds.read_stream(spark, sf, "events").withColumn("topic", F.col("user_id") % 5)
    return feeds.drain(feeds.topic_events(events, "topic", "event_type", 0, "CLICK").select("event_id", "user_id"))


@query("WITH o AS (SELECT DISTINCT user_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'), n AS (SELECT DISTINCT user_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03') SELECT user_id, event_type, 'join' AS change FROM n WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM o) UNION ALL SELECT user_id, event_type, 'leave' FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM n)")
def st3_presence_diff(spark, sf):
    day = lambda d: t(spark, sf, "events").where(F.col("ts").cast("date") == F.lit(d).cast("date"))
    return feeds.presence_diff(day("2024-01-02"), day("2024-01-03"), ["user_id", "event_type"])


@query()
def st4_presence_state(spark, sf):
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _PRESENCE.items()])
    rows = feeds.read_stream(spark, sf, "events").withColumn("action", action).where("action is not null").withColumn("ref", F.col("event_id") % 3)
    return feeds.drain_updates(feeds.presence_state(rows, "user_id", "ref", "action", "ts"), ["key"])


@query()
def st5_presence_pending(spark, sf):
    """Presence that begins with a snapshot: changes wait for the first purchase, which lists refs 0 and 1."""
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in {**_PRESENCE, "purchase": "sync"}.items()])
    ref = F.when(F.col("event_type") == "purchase", "0,1").otherwise((F.col("event_id") % 3).cast("string"))
    rows = feeds.read_stream(spark, sf, "events").withColumn("action", action).where("action is not null").withColumn("ref", ref)
    return feeds.drain_updates(feeds.presence_state(rows, "user_id", "ref", "action", "ts", synced=False), ["key"])


@query("SELECT user_id, event_type, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2)) WHERE place <= 3")
def st6_recent_distinct(spark, sf):
    return feeds.recent_distinct(t(spark, sf, "events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts", 3)


@query("SELECT user_id, event_type, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2)) WHERE place <= 3")
def st6_recent_stream(spark, sf):
    recent = stateful.recent_stream(feeds.read_stream(spark, sf, "events"), "user_id", "event_type", "ts", 3)
    return feeds.drain_updates(recent, ["user_id", "place"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def st7_toggles(spark, sf):
    keys = ["user_id", "event_type"]
    return feeds.drain_updates(feeds.toggle_stream(feeds.read_stream(spark, sf, "events"), keys, "ts"), keys).where("n % 2 = 1").select(keys)


@query("SELECT DISTINCT user_id, event_type FROM events")
def st8_ttl_dedup(spark, sf):
    events = feeds.read_stream(spark, sf, "events").select("user_id", "event_type", "ts")
    return feeds.drain(feeds.ttl_dedup(events, ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, t AS kept, false AS hit FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.rn, CASE WHEN e.t - r.kept < 21600000000 THEN r.kept ELSE e.t END, e.t - r.kept < 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, hit FROM r""")
def st8_ttl_stream(spark, sf):
    """The cache of st8_ttl_hits as a stream; a key's time to live of six hours is over many times in the data."""
    return feeds.drain(stateful.cache_stream(feeds.read_stream(spark, sf, "events"), "user_id", "ts", "event_id", 6 * 3600))


@query(SQL["st8_ttl_stream"])
def st8_ttl_hits(spark, sf):
    return feeds.ttl_hits(t(spark, sf, "events"), "user_id", "ts", "event_id", 6 * 3600)


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, k, rn, [{'k': k, 't': t}] AS kept, false AS hit FROM e WHERE rn = 1
UNION ALL SELECT event_id, user_id, k, rn, CASE WHEN hit THEN kept ELSE list_concat(list_filter(kept, lambda x: x.k <> k), [{'k': k, 't': t}])[-2:] END, hit
FROM (SELECT e.*, r.kept, len(list_filter(r.kept, lambda x: x.k = e.k AND e.t - x.t < 604800000000)) > 0 AS hit FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT k AS event_type, event_id, hit FROM r""")
def st8_bounded_stream(spark, sf):
    """The cache of st8_bounded_hits as a stream."""
    cache = stateful.cache_stream(feeds.read_stream(spark, sf, "events"), "event_type", "ts", "event_id", 7 * 24 * 3600, client="user_id", most_keys=2)
    return feeds.drain(cache).select("event_type", "event_id", "hit")


@query(SQL["st8_bounded_stream"])
def st8_bounded_hits(spark, sf):
    return feeds.ttl_hits(t(spark, sf, "events"), "event_type", "ts", "event_id", 7 * 24 * 3600, client="user_id", most_keys=2)


@query("SELECT user_id, count(*) FILTER (odd) AS n_done, bool_and(odd) AS all_done, bool_or(odd) AS any_done, CAST(floor(count(*) FILTER (odd) * 100 / 7) AS BIGINT) AS percent FROM (SELECT user_id, event_type, count(*) % 2 = 1 AS odd FROM events GROUP BY 1, 2) GROUP BY 1")
def st9_progress_toggles(spark, sf):
    every = t(spark, sf, "events").select("user_id", "event_type").distinct()
    on = setops.toggle_state(t(spark, sf, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", F.lit(True).alias("on"))
    state = every.join(on, ["user_id", "event_type"], "left")
    return aggregates.progress(state, ["user_id"], F.coalesce("on", F.lit(False)))
