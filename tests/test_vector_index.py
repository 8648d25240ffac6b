"""The vector index against brute force, and how much of it a query meets."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quirelight.functions import vector_index, vectors

SCHEMA = "vec_id bigint, embedding array<double>"


def clusters(n, n_clusters, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, 16))
    return centres[rng.integers(0, n_clusters, n)] + spread * rng.normal(size=(n, 16))


def frame(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA).repartition(3)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 5) + 0.0) for r in df.collect())


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_index_equals_brute_force_and_skips_most_cells(spark, tmp_path, metric):
    index = frame(spark, clusters(3000, 40))
    asked = frame(spark, clusters(3040, 40)[3000:], 10_000)
    vector_index.write_vectors(index, f"{tmp_path}/i", metric, cells=60)
    seen = {}
    got = rows(vector_index.query_index(spark, f"{tmp_path}/i", asked, 7, seen=seen))
    assert got == rows(vectors.query_vectors(index, asked, 7, metric)) and len(got) == 280
    n_cells = spark.read.parquet(f"{tmp_path}/i/cells").count()
    if metric != "dot":  # long vectors of other clusters may have large products
        assert seen["pairs"] < 40 * n_cells / 4 and seen["rows"] < 40 * 3000 / 4
    one = {}
    vector_index.query_index(spark, f"{tmp_path}/i", asked.orderBy("vec_id").limit(1), 7, seen=one)
    if metric != "dot":
        assert one["cells"] < n_cells / 4  # the folders that are read


def test_blocks_of_queries_are_joined(spark, tmp_path):
    index = frame(spark, clusters(500, 8))
    vector_index.write_vectors(index, f"{tmp_path}/i", "l2", cells=10)
    asked = index.where("vec_id % 9 = 0")
    assert rows(vector_index.query_index(spark, f"{tmp_path}/i", asked, 5, block=10)) == rows(vectors.query_vectors(index, asked, 5, "l2"))


def test_calibrated_recall_is_reached(spark, sf_dir, tmp_path):
    index = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector_index.write_vectors(index, f"{tmp_path}/i")
    probe = vector_index.calibrate(spark, f"{tmp_path}/i", 10, 0.95)
    asked = index.where("vec_id % 3 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.query_vectors(index, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vector_index.query_index(spark, f"{tmp_path}/i", asked, 10, probe).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    clustered = frame(spark, clusters(2000, 20))
    vector_index.write_vectors(clustered, f"{tmp_path}/c", cells=40)
    assert vector_index.calibrate(spark, f"{tmp_path}/c", 10, 0.95) < 10


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_odd_vectors(spark, tmp_path, metric):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.6, 0.8]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [-2.0, 0.5])]
    df = spark.createDataFrame(odd, SCHEMA).repartition(2)
    vector_index.write_vectors(df, f"{tmp_path}/i", metric, cells=2)
    asked = df.where("vec_id not in (2, 5)")
    want = [r for r in rows(vectors.query_vectors(df.where("vec_id not in (4, 5)"), asked, 3, metric)) if r[0] not in (4, 5)]
    assert rows(vector_index.query_index(spark, f"{tmp_path}/i", asked, 3)) == want
    vector_index.write_vectors(df.limit(0), f"{tmp_path}/e", metric)
    assert vector_index.query_index(spark, f"{tmp_path}/e", asked, 3).collect() == []
    assert vector_index.query_index(spark, f"{tmp_path}/i", asked.limit(0), 3).collect() == []


def test_lengths_that_the_sample_lacks_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE", 20)
    df = frame(spark, clusters(300, 5)).union(spark.createDataFrame([(1000, [1.0, 2.0]), (1001, [2.0, 1.0])], SCHEMA))
    vector_index.write_vectors(df, f"{tmp_path}/i", "l2")
    asked = df.where("vec_id >= 1000 or vec_id % 50 = 0")
    assert rows(vector_index.query_index(spark, f"{tmp_path}/i", asked, 3)) == rows(vectors.query_vectors(df, asked, 3, "l2"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_large_cells_meet_the_queries_a_slice_at_a_time(spark, tmp_path, monkeypatch, metric):
    index = frame(spark, clusters(300, 1))
    vector_index.write_vectors(index, f"{tmp_path}/i", metric, cells=1)
    known = spark.read.parquet(f"{tmp_path}/i/cells").collect()
    asked = clusters(1000, 1, seed=1)
    cells = vector_index._Cells(known, asked, metric)
    blocks = {16: (np.arange(1000), cells, np.ones((1000, 1), bool), np.full(1000, -np.inf))}
    monkeypatch.setattr(type(index), "mapInArrow", lambda self, fn, schema: fn)
    run = vector_index._scan(spark, f"{tmp_path}/i", blocks, 5)
    m = clusters(10_000, 1, seed=2)
    v = pa.ListArray.from_arrays(pa.array(range(0, 160_001, 16), pa.int32()), pa.array(m.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array(np.zeros(10_000)), v, pa.array(np.full(10_000, known[0].cell, np.int32))], names=["key", "dist", "v", "cell"])
    tracemalloc.start()
    n = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 5000 and peak < 70  # 80 MB for each matrix of all queries by all rows
