"""Vector collections: upsert, get, list, delete and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from ..sources.tables import delete_keys, upsert

METRICS = ("cosine", "dot", "l2")
#: Queries that are sent to the tasks at a time, and vectors that they are compared with at a time.
QUERY_BLOCK, ROWS_AT_ONCE = 4096, 1024


def put_vectors(index: DataFrame, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    return upsert(index, rows, [key])


def get_vectors(index: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(keys.select(key), key, "left_semi")


def list_vectors(index: DataFrame, segment: int = 0, of: int = 1, key: str = "vec_id") -> DataFrame:
    """Every vector, or segment i of n for parallel scans; n is 16 at most."""
    if not 0 <= segment < of <= 16:
        raise ValueError("segments are numbered from 0, and are 16 at most")
    return index if of == 1 else index.where(F.pmod(F.col(key), F.lit(of)) == segment)


def delete_vectors(index: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return delete_keys(index, keys, [key])


def query_vectors(index: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", where: Column | None = None, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k best vectors of each query; larger scores are better, l2 is negated.

    The queries are a stated set, dealt by hash into blocks of about `block`; one block at a time is sent to the tasks, and its best are written before the next. A
    task keeps its k best of each query over all its rows, so that k rows per query and task are shuffled, not all pairs. Ties go to the smaller key. Each query meets
    the vectors of its own length; null vectors, and those with null or NaN elements, do not take part.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = (index if where is None else index.where(where)).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    asked = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).dropna()
    n_blocks = max(1, -(-asked.count() // block))
    scratch = Scratch(index.sparkSession)
    parts = []
    for b in range(n_blocks):
        found = _nearest(rows, asked.where(F.pmod(F.xxhash64("q", "v"), F.lit(n_blocks)) == b).toArrow(), k, metric)
        parts.append(found if n_blocks == 1 else scratch.keep(_ranked(found, k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    ranked = _ranked(out, k) if n_blocks == 1 else out
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))).where(F.col("rank") <= k)


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the vectors of each length."""
    lengths = pc.list_value_length(vectors)
    for n in pc.unique(lengths).to_pylist():
        same = pc.equal(lengths, n)
        values = pc.list_flatten(vectors.filter(same)).to_numpy(zero_copy_only=False).astype(np.float64)
        own = ids.filter(same).to_numpy(zero_copy_only=False)
        yield n, own, values.reshape(len(own), n)


class _Best:
    """The k best vectors seen so far of some queries of one length."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int, metric: str):
        self.ids, self.k, self.metric = ids, k, metric
        self.asked = _unit(asked) if metric == "cosine" else asked
        self.least = np.full(len(ids), -np.inf)  # a score that is lower is none of the k best
        self.query, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, keys: np.ndarray, m: np.ndarray, only: np.ndarray | None = None) -> None:
        """only: the places of the queries that are to meet these vectors; by default all."""
        at, step = 0, max(64, 2 * self.k)  # the first few give the bounds for the rest
        only = np.arange(len(self.ids)) if only is None else only
        while at < len(keys):
            self._see(keys[at : at + step], m[at : at + step], only)
            at, step = at + step, ROWS_AT_ONCE

    def _see(self, keys: np.ndarray, m: np.ndarray, only: np.ndarray) -> None:
        a = self.asked[only]
        if self.metric == "l2":
            score = -np.sqrt(np.maximum((a**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * a @ m.T, 0))
        else:
            score = a @ (_unit(m) if self.metric == "cosine" else m).T
        q, v = np.nonzero(score >= self.least[only][:, None])
        query, key, score = (np.concatenate(x) for x in ((self.query, only[q]), (self.key, keys[v]), (self.score, score[q, v])))
        order = np.lexsort((key, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        self.query, self.key, self.score = query[kept], key[order][kept], score[order][kept]
        n = np.bincount(self.query, minlength=len(self.ids))
        full = np.flatnonzero(n >= self.k)
        self.least[full] = np.maximum(self.least[full], self.score[np.cumsum(n)[full] - 1])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _nearest(rows: DataFrame, asked: pa.Table, k: int, metric: str) -> DataFrame:
    """(query_id, key, score): of each task, the k best for each of the asked (q, v)."""
    blocks = {n: (ids, m) for n, ids, m in _by_length(asked["q"].combine_chunks(), asked["v"].combine_chunks())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(ids, m, k, metric) for n, (ids, m) in blocks.items()}
        for batch in batches:
            for n, keys, m in _by_length(batch.column(0), batch.column(1)):
                if n in best:
                    best[n].see(keys, m)
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.query]), pa.array(b.key), pa.array(b.score)], names=["query_id", "key", "score"])

    return rows.mapInArrow(run, "query_id bigint, key bigint, score double")
