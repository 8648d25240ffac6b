"""Tables between jobs, and where they may lie."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quirelight.sources import shared


def session(master, named=None):
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared.shared_folder(session(master))
    assert shared.shared_folder(session(master, "hdfs://name/shared")).startswith("hdfs://name/shared/tables-")


def test_tables_are_kept_and_removed(spark):
    scratch = shared.Scratch(spark)
    one, two = scratch.keep(spark.range(10).withColumn("t", F.lit("x"))), scratch.keep(spark.range(0))
    folders = [Path(p.removeprefix("file:")) for _, p in scratch.kept]
    assert (one.count(), two.count()) == (10, 0) and all(f.is_dir() for f in folders)
    scratch.drop_all_but(one)
    assert folders[0].is_dir() and not folders[1].exists() and one.count() == 10
    scratch.drop(one)
    assert not folders[0].exists() and not scratch.tables()
