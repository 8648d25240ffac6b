"""Counts, groupings and distinct rows. Groups are aggregated partially before they are shuffled."""

from __future__ import annotations

import math
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_rows(df: DataFrame, mode: str = "exact", fraction: float = 0.05) -> DataFrame:
    """One row with the count n; mode "estimated" counts a share of the files, as estimated_count() does."""
    return df.agg(F.count(F.lit(1)).alias("n")) if mode == "exact" else estimated_count(df, fraction).select("n")


#: Files that are counted at least, and how many standard errors the bound is wide.
LEAST_FILES, ERRORS = 20, 4


def estimated_count(df: DataFrame, fraction: float = 0.05) -> DataFrame:
    """One row (n, bound): about how many rows df has, and how far from it the exact count may lie.

    df is filters and projections over files, some of which are drawn by a hash of their names; Spark opens no others. n is the mean of their counts times the number of
    files, and bound is ERRORS standard errors of it, with the correction for drawing from few. Of LEAST_FILES files or fewer, all are counted: n is exact and bound 0.
    """
    files = sorted((re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in df.inputFiles()), key=lambda f: (zlib.crc32(f.encode()), f))
    m = max(LEAST_FILES, math.ceil(fraction * len(files)))
    if len(files) <= m:
        return df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("bound"))
    path = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")  # the two ways to name a file differ in their slashes
    per = df.where(path.isin(files[:m])).groupBy(path.alias("f")).agg(F.count(F.lit(1)).cast("double").alias("c"))  # a file without hits has no row here
    mean = F.coalesce(F.sum("c"), F.lit(0.0)) / m
    spread = F.sqrt(F.greatest((F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)) - m * mean * mean) / (m - 1), F.lit(0.0)))
    return per.agg(F.round(mean * len(files)).cast("bigint").alias("n"), F.ceil(ERRORS * len(files) * spread * math.sqrt((1 - m / len(files)) / m)).alias("bound"))


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, n), one row for each relation."""
    one = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, one)


def group_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), with the total of each outer key."""
    counts = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(outer)))


def collect_groups(df: DataFrame, key: str, order: list[str], field: str, sep: str = ",") -> DataFrame:
    """Each group's values in order, as one string, and their number."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(field).alias("__v"))))
    return df.groupBy(key).agg(rows.alias("r"), F.count(F.lit(1)).alias("n")).select(key, F.array_join(F.transform("r", lambda x: x["__v"].cast("string")), sep).alias("items"), "n")


def nested_groups(df: DataFrame, outer: str, inner: str, item: str, default: str = "other") -> DataFrame:
    """(outer, groups): for each outer key, the inner keys in order with their sorted items; null keys get the default."""
    keyed = df.select(F.coalesce(F.col(outer), F.lit(default)).alias("outer"), F.coalesce(F.col(inner), F.lit(default)).alias("inner"), item)
    inner_rows = keyed.groupBy("outer", "inner").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return inner_rows.groupBy("outer").agg(F.sort_array(F.collect_list(F.struct("inner", "items"))).alias("groups"))


def rollup_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), by outer, and overall; level: 0, 1 and 3."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def markers(df: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """Each unit's markers that are not null, in order."""
    listed = F.sort_array(F.collect_list(F.when(F.col(marker).isNotNull(), F.struct(order, marker))))
    return df.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[marker]), ",").alias("markers"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values without null and 0, in order."""
    return df.select(col).where(F.col(col).isNotNull() & (F.col(col) != 0)).distinct().orderBy(col)


def table_of_contents(df: DataFrame, book: str, chapter: str) -> DataFrame:
    """Each book's chapters, once each and in order."""
    return df.groupBy(book).agg(F.sort_array(F.collect_set(chapter)).alias("c")).select(book, F.array_join(F.col("c").cast("array<string>"), ",").alias("chapters"))


def first_distinct(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def bucket_groups(df: DataFrame, col: str, label: str = "other") -> DataFrame:
    """Counts by a number, with null and 0 under the label; in number order."""
    bucket = F.coalesce(F.col(col), F.lit(0))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("label", F.when(F.col("bucket") == 0, label).otherwise(F.col("bucket").cast("string"))).orderBy("bucket")


def split_collections(df: DataFrame, collection: str, row_id: str, loose: int = 5) -> DataFrame:
    """(collection, n, ids): each collection with its size and first ids, and the first `loose` rows without one."""
    grouped = df.where(F.col(collection).isNotNull()).groupBy(collection).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id"))
    single = df.where(F.col(collection).isNull()).orderBy(row_id).limit(loose)
    return grouped.unionByName(single.select(collection, F.lit(1).cast("long").alias("n"), F.col(row_id).alias("first_id")))


def progress(df: DataFrame, group: list[str], done: Column, of: int = 7) -> DataFrame:
    """Per group: number done, all and any done, and percent of `of`."""
    out = df.groupBy(*group).agg(F.count_if(done).alias("n_done"), F.bool_and(done).alias("all_done"), F.bool_or(done).alias("any_done"))
    return out.withColumn("percent", F.floor(F.col("n_done") * 100 / of).cast("long"))


def majority_flag(df: DataFrame, group: str, cond: Column, out: str = "majority") -> DataFrame:
    """df with a flag: at least half of the group's rows, rounded up, meet the condition. Counted apart, then joined."""
    flags = df.groupBy(group).agg((F.count_if(cond) >= F.ceil(F.count(F.lit(1)) / 2)).alias(out))
    return df.join(flags, group)


def top_entities(counted: DataFrame, name: str, counts: list[str], n: int = 10) -> DataFrame:
    total = reduce(Column.__add__, [F.col(c) for c in counts])
    return counted.withColumn("total", total).orderBy(F.col("total").desc(), name).limit(n)


def theme_counts(docs: DataFrame, text: str, themes: list[str]) -> DataFrame:
    """(theme, n): how many texts have each theme word; one pass over the texts, themes without hits included."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^a-z0-9à-ÿ]+"))
    found = F.array_intersect(words, F.array(*[F.lit(t) for t in themes]))
    hits = docs.select(F.explode(found).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.createDataFrame([(t,) for t in themes], "theme string")
    return every.join(hits, "theme", "left").select("theme", F.coalesce("n", F.lit(0)).alias("n"))


def facet_counts(facets: dict[str, DataFrame]) -> DataFrame:
    """(facet, n) of each related set."""
    return count_tables(facets).withColumnRenamed("relation", "facet")
