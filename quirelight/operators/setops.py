"""Unions of relations, fallbacks, and state from toggles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def search_all(kinds: dict[str, tuple[DataFrame, str, str, int]], needle: str) -> DataFrame:
    """(kind, id, total, rank): for each kind (relation, id, text column, cap) its first hits and the number of all. Texts are searched once; the hits' ids are written, and counted and ranked."""
    parts, scratch = [], Scratch(next(iter(kinds.values()))[0].sparkSession)
    for kind, (df, row_id, text, cap) in kinds.items():
        hits = scratch.keep(df.where(F.contains(F.lower(F.col(text)), F.lit(needle.lower()))).select(F.lit(kind).alias("kind"), F.col(row_id).cast("string").alias("id"), F.col(row_id).alias("__order")))
        total = hits.agg(F.count(F.lit(1)).alias("total"))
        first = hits.orderBy("__order").limit(cap)
        parts.append(first.join(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("__order"))).drop("__order"))  # total is one row, first at most cap
    out = scratch.keep(reduce(DataFrame.unionByName, parts))
    scratch.drop_all_but(out)
    return out


def leading_kind(totals: DataFrame, order: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """(kind): the first kind of the order that has hits. totals: (kind, total)."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    return totals.where((F.col("total") > 0) & ~F.col("kind").isin(list(skip))).agg(F.min_by("kind", place).alias("kind"))


def prefer_or_any(df: DataFrame, cond: Column) -> DataFrame:
    """The rows that meet cond; all rows if none does."""
    any_row = df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("__any"))
    return df.join(F.broadcast(any_row)).where(cond | ~F.col("__any")).drop("__any")  # one row


def suggest(history: DataFrame, names: DataFrame, prefix: str, from_history: int = 3, limit: int = 7) -> DataFrame:
    """(value, place): up to from_history earlier queries, then names not among them, that begin with the prefix. history: (value, ts); names: (value, ord)."""
    starts = lambda df: df.where(F.startswith(F.lower("value"), F.lit(prefix.lower())))
    old = starts(history).groupBy("value").agg(F.max("ts").alias("ts")).orderBy(F.col("ts").desc(), "value").limit(from_history)
    old = old.select("value", F.lit(0).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("ts").desc(), "value")).cast("long").alias("ord"))  # at most from_history rows
    new = starts(names).join(old.select("value"), "value", "left_anti").groupBy("value").agg(F.min("ord").cast("long").alias("ord")).orderBy("ord", "value").limit(limit)
    both = old.unionByName(new.select("value", F.lit(1).alias("kind"), "ord")).orderBy("kind", "ord", "value").limit(limit)
    return both.select("value", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("kind", "ord", "value")).alias("place"))  # at most limit rows


def toggle_state(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Keys toggled an odd number of times, with the latest time."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ts")).where("n % 2 = 1").drop("n")


def all_bookmarks(kinds: dict[str, DataFrame]) -> DataFrame:
    """The rows of all kinds with the kind's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()])


def distinct_keys(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def mode_rows(df: DataFrame, group: str, whole: Column) -> DataFrame:
    """Per group: the rows that speak of the whole if there are any, else the others."""
    flags = df.groupBy(F.col(group).alias("__g")).agg(F.bool_or(whole).alias("__whole"))
    return df.join(flags, F.col(group).eqNullSafe(F.col("__g"))).where(whole.eqNullSafe(F.col("__whole"))).drop("__g", "__whole")
