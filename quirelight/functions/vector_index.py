"""Nearest vectors on an index of cells around centroids: exact with most cells skipped, or approximate by the nearest cells.

Centroids are fitted on a bounded sample (SAMPLE rows, those with the smallest hashes); every row is indexed, under its nearest centroid of its own length, with its distance to it.
Cells are folders. What is known of a cell is small: its centroid, its number of rows and their least and largest distance to it. The triangle inequality turns these into a
bound: no vector of a cell can be nearer to a query than the query's distance to the centroid lets it be (for dot products, the Cauchy-Schwarz inequality gives the like). An exact
query first reads the nearest cells that hold k vectors, and then only cells whose bound reaches its kth best score; within a cell, rows whose own distance to the centroid
rules them out are not compared. Where vectors lie in no clusters, as random ones do, bounds rule out little, and exact queries read nearly everything.

An approximate query reads the `probe` cells of the best bounds; calibrate() measures, for a bounded sample of indexed vectors, which number finds the asked share of the exact neighbours.
Queries are a stated set and go to the tasks in blocks, as in vectors.query_vectors; so do the cells' centroids, of which there are at most MOST_CELLS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .vectors import METRICS, QUERY_BLOCK, ROWS_AT_ONCE, _Best, _by_length, _ranked, _unit

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 12
_SLACK = 1e-6  # bounds are compared with scores that are rounded, in proportion to the query's length


def _plain(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _centroids(m: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from n rows drawn at random."""
    c = m[np.random.default_rng(seed).permutation(len(m))[:n]]
    for _ in range(ROUNDS):
        own = _distances(m, c).argmin(1)
        sizes = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def write_vectors(index: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> None:
    """Index every row of index under path. cells: how many for each length of vectors; by default the root of the sample's size. Null vectors, and those with null or NaN elements, do not take part."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = _plain(index, key, vector)
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow().combine_chunks()
    found: dict[int, np.ndarray] = {}
    if sample.num_rows:
        for n, ids, m in _by_length(sample["key"].combine_chunks(), sample["v"].combine_chunks()):
            found[n] = _centroids(_unit(m) if metric == "cosine" else m, min(MOST_CELLS, cells or max(1, int(len(ids) ** 0.5)), len(ids)), seed)
    starts = dict(zip(found, np.cumsum([0, *map(len, found.values())]), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, m in _by_length(batch.column(0), batch.column(1)):
                if n in found:
                    d = _distances(_unit(m) if metric == "cosine" else m, found[n])
                    cell = d.argmin(1)
                    dist, cell = d[np.arange(len(ids)), cell], cell + starts[n]
                else:  # a length that the sample lacks: one cell without a centroid, which every query of that length reads
                    dist, cell = np.zeros(len(ids)), np.full(len(ids), -1 - n)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(ids, pa.int64()), pa.array(dist), values], names=["cell", "key", "dist", "v"])

    laid = rows.mapInArrow(run, "cell int, key bigint, dist double, v array<double>").hint("rebalance", "cell").sortWithinPartitions("cell", "dist")
    laid.write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/rows")
    spark = index.sparkSession
    places = [(int(starts[n] + i), [float(x) for x in row]) for n, c in found.items() for i, row in enumerate(c)]
    known = spark.createDataFrame(places, "cell int, centroid array<double>")
    sizes = _rows(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("nearest"), F.max("dist").alias("farthest"))
    sizes.join(known, "cell", "left").withColumn("metric", F.lit(metric)).write.parquet(f"{path}/cells")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key bigint, dist double, v array<double>, cell int").parquet(f"{path}/rows")


class _Cells:
    """What is known of the cells, and the bounds that follow for some queries of one length."""

    def __init__(self, rows: list, asked: np.ndarray, metric: str):
        self.metric, self.asked = metric, _unit(asked) if metric == "cosine" else asked
        self.slack = _SLACK * np.maximum(1, np.linalg.norm(self.asked, axis=1))[:, None]
        n = asked.shape[1]
        with_centre = [r for r in rows if r.centroid is not None and len(r.centroid) == n]
        without = [r for r in rows if r.cell == -1 - n]
        self.ids = np.array([r.cell for r in (*with_centre, *without)], np.int64)
        self.sizes = np.array([r.n for r in (*with_centre, *without)], np.int64)
        centre = np.array([r.centroid for r in with_centre], np.float64).reshape(len(with_centre), n)
        near, far = (np.array([getattr(r, x) for r in with_centre]) for x in ("nearest", "farthest"))
        self.distance = _distances(self.asked, centre)
        if metric == "dot":
            bound = self.asked @ centre.T + np.linalg.norm(self.asked, axis=1)[:, None] * far
        else:
            least = np.maximum(0, np.maximum(self.distance - far, near - self.distance))
            bound = -least if metric == "l2" else 1 - least**2 / 2
        self.bound = np.concatenate([bound, np.full((len(asked), len(without)), np.inf)], axis=1)
        order = np.concatenate([self.asked @ centre.T if metric == "dot" else -self.distance, np.full((len(asked), len(without)), np.inf)], axis=1)
        self.order = np.argsort(-order, axis=1, kind="stable")  # the nearest cells first

    def first(self, k: int, probe: int | None) -> np.ndarray:
        """For each query (row) and cell: whether it is among the nearest that hold k vectors, or the nearest `probe`."""
        held = np.cumsum(self.sizes[self.order], axis=1) - self.sizes[self.order]
        rank = np.arange(len(self.ids))[None]
        chosen = (rank < probe) if probe else (held < k)
        out = np.zeros(self.bound.shape, bool)
        np.put_along_axis(out, self.order, np.broadcast_to(chosen, out.shape), axis=1)
        return out


def _scan(spark: SparkSession, path: str, blocks: dict[int, tuple[np.ndarray, _Cells, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query_id, key, score): of each task, the k best for each query among the cells chosen for it. blocks: length -> (ids, cells, chosen, least)."""
    wanted = sorted({int(c) for _, cells, chosen, _ in blocks.values() for c in cells.ids[chosen.any(0)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for n, (ids, cells, _, least) in blocks.items():
            best[n] = _Best(ids, cells.asked, k, cells.metric)
            best[n].asked, best[n].least = cells.asked, least.copy()
        place = {int(c): (n, at) for n, (_, cells, _, _) in blocks.items() for at, c in enumerate(cells.ids)}
        for batch in batches:
            cell = batch.column(3).to_numpy()
            for lo, hi in _stretches(cell):
                if int(cell[lo]) not in place:
                    continue
                n, at = place[int(cell[lo])]
                _, cells, chosen, _ = blocks[n]
                only = np.flatnonzero(chosen[:, at])
                for start in range(lo, hi, ROWS_AT_ONCE):  # a matrix of queries by rows at a time, however many rows a cell has
                    part = batch.slice(start, min(ROWS_AT_ONCE, hi - start))
                    keys = part.column(0).to_numpy()
                    m = part.column(2).flatten().to_numpy().reshape(len(keys), n)
                    if at < cells.distance.shape[1] and cells.metric != "dot":  # rows that lie too far in or out are not compared
                        gap = np.abs(cells.distance[only, at][:, None] - part.column(1).to_numpy()[None])
                        reach = -gap if cells.metric == "l2" else 1 - gap**2 / 2
                        some = (reach + cells.slack[only] >= best[n].least[only][:, None]).any(0)
                        keys, m = keys[some], m[some]
                    best[n].see(keys, m, only)
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.query]), pa.array(b.key), pa.array(b.score)], names=["query_id", "key", "score"])

    return _rows(spark, path).where(F.col("cell").isin(wanted)).mapInArrow(run, "query_id bigint, key bigint, score double")


def _stretches(cell: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(cell)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True) if len(cell) else iter(())


def query_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probe: int | None = None, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK, seen: dict | None = None) -> DataFrame:
    """(query_id, key, score, rank) as vectors.query_vectors gives them, by the metric of the index. probe: approximate, by so many cells. seen: gets the numbers of cells, pairs of query and cell, and rows met."""
    known = spark.read.parquet(f"{path}/cells").collect()  # MOST_CELLS rows for each length at most
    asked = _plain(queries, key, vector)
    n_blocks = max(1, -(-asked.count() // block))
    scratch, parts = Scratch(spark), []
    for b in range(n_blocks):
        some = asked.where(F.pmod(F.xxhash64("key", "v"), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        if some.num_rows and known:
            parts.append(_query_block(spark, path, known, some, k, probe, scratch, seen if seen is not None else {}))
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("query_id", F.col("key").alias(key), "score", "rank")


def _query_block(spark: SparkSession, path: str, known: list, asked: pa.Table, k: int, probe: int | None, scratch: Scratch, seen: dict) -> DataFrame:
    blocks = {}
    for n, ids, m in _by_length(asked["key"].combine_chunks(), asked["v"].combine_chunks()):
        cells = _Cells(known, m, known[0].metric)
        blocks[n] = (ids, cells, cells.first(k, probe), np.full(len(ids), -np.inf))

    def count() -> None:
        for _, cells, chosen, _ in blocks.values():
            for what, n in (("cells", chosen.any(0).sum()), ("pairs", chosen.sum()), ("rows", (chosen * cells.sizes[None]).sum())):
                seen[what] = seen.get(what, 0) + int(n)

    count()
    first = scratch.keep(_ranked(_scan(spark, path, blocks, k), k))
    if probe:
        return first
    kth = first.where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row for each query of the block
    least = dict(zip(kth["query_id"].to_pylist(), kth["score"].to_pylist(), strict=True))
    for n, (ids, cells, chosen, _) in blocks.items():
        reached = np.array([least.get(int(i), -np.inf) for i in ids])
        blocks[n] = (ids, cells, (cells.bound + cells.slack >= reached[:, None]) & ~chosen, reached)
    count()
    rest = _scan(spark, path, blocks, k)
    out = scratch.keep(_ranked(first.drop("rank").union(rest), k))
    scratch.drop(first)
    return out


def calibrate(spark: SparkSession, path: str, k: int = 10, target: float = 0.9, sample: int = 256) -> int:
    """How many cells an approximate query must read to find the target share of the exact neighbours, as measured for a sample of the indexed vectors."""
    rows = _rows(spark, path)
    some = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select(F.col("key").alias("vec_id"), F.col("v").alias("embedding"))
    exact = query_index(spark, path, some, k)
    met = exact.join(rows.select("key", "cell"), F.col("vec_id") == F.col("key")).select("query_id", "cell").collect()  # k for each of the sample
    known = spark.read.parquet(f"{path}/cells").collect()
    asked = some.toArrow().combine_chunks()
    ranks = []
    for _, ids, m in _by_length(asked["vec_id"].combine_chunks(), asked["embedding"].combine_chunks()):
        cells = _Cells(known, m, known[0].metric)
        at = {int(i): {int(cells.ids[c]): r for r, c in enumerate(order)} for i, order in zip(ids, cells.order, strict=True)}
        ranks += [at[r.query_id][r.cell] for r in met if r.query_id in at]
    return int(np.sort(ranks)[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1 if ranks else 1
