"""Full-text search on an index of positional posting lists, written once and partitioned by term.

A posting is (term, key, positions). Terms are dealt into buckets, which are folders; within their files rows are in the order of terms. A query reads the buckets of its own terms, and
within them the row groups that have these; the positions too only if it asks for a phrase. Posting lists meet by document: one row per document with
a list or a mark for each asked term, on which AND, OR and NOT are decided and the places of a phrase's words are intersected after shifting. Documents without
any asked term come in only where the query accepts such documents (all its parts are negations), from the table of all keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .search import clauses, tokens
from .udfs import WORDS_AT_ONCE, pieces, stem_word, stemmed

BUCKETS = 64


def postings(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(term, key, positions): one row for each term of each row of df."""
    toks = tokens(F.col(text))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), (stemmed(toks, lang) if lang else toks).alias("toks"))
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["key"], T.StructField("positions", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def laid_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        code = words.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((place, code, row))
        row, code, place = row[order], code[order], place[order]
        first = np.flatnonzero(np.r_[len(row) > 0, (np.diff(row) != 0) | (np.diff(code) != 0)]) if len(row) else np.zeros(0, np.int64)
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place, pa.int32()))
        columns = [words.dictionary.take(pa.array(code[first])), batch.column(0).take(pa.array(row[first])), positions]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), WORDS_AT_ONCE):
                yield laid_out(batch.slice(lo, hi - lo))

    return rows.mapInArrow(run, schema)


def write_index(df: DataFrame, key: str, text: str, path: str, lang: str | None = None, buckets: int = BUCKETS) -> None:
    """Write the index of df's texts under path. key must tell rows apart: rows that share one are one document. lang: index word stems of that language."""
    rows = postings(df, key, text, lang).withColumn("bucket", (F.crc32("term") % buckets).cast("int"))
    laid = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")  # adaptive execution splits the buckets of frequent terms
    laid.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    df.select(F.col(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(lang).cast("string").alias("lang")).write.option("compression", "zstd").parquet(f"{path}/keys")


def search_index(spark: SparkSession, path: str, query: str, mode: str = "websearch") -> DataFrame:
    """(key) of the documents that search.text_search would find, in the same modes."""
    keys = spark.read.parquet(f"{path}/keys")
    made = keys.select("buckets", "lang").limit(1).collect()
    if not made:
        return keys.select("key")
    buckets, lang = made[0]
    asked = [[(minus, [stem_word(w, lang) if lang else w for w in words]) for minus, words in group] for group in clauses(query, mode)]
    if not asked:
        return keys.select("key").limit(0)
    terms = list(dict.fromkeys(w for group in asked for _, words in group for w in words))
    placed = {w for group in asked for _, words in group if len(words) > 1 for w in words}
    rows = spark.read.schema(_schema(keys)).parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % buckets for w in terms})) & F.col("term").isin(terms))
    column = {w: f"t{i}" for i, w in enumerate(terms)}
    found = rows.groupBy("key").agg(*[(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True) if w in placed else F.max(F.when(F.col("term") == w, F.lit(True)))).alias(c) for w, c in column.items()])

    def meets(minus: bool, words: list[str]) -> Column:
        has = [F.col(column[w]).isNotNull() for w in words]
        if len(words) == 1:
            return ~has[0] if minus else has[0]
        starts = reduce(F.array_intersect, [_shifted(column[w], n) for n, w in enumerate(words)])
        phrase = F.when(reduce(Column.__and__, has), F.size(starts) > 0).otherwise(F.lit(False))
        return ~phrase if minus else phrase

    if all(any(minus for minus, _ in group) for group in asked):  # a document without any of the terms is a hit
        found = keys.select("key").distinct().join(found.withColumnRenamed("key", "__k"), F.col("key").eqNullSafe(F.col("__k")), "left")
    return found.where(reduce(Column.__and__, [reduce(Column.__or__, [meets(*part) for part in group]) for group in asked])).select("key")


def _shifted(positions: str, n: int) -> Column:
    return F.transform(positions, lambda p: p - n)


def _schema(keys: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), keys.schema["key"], T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("bucket", T.IntegerType())])
