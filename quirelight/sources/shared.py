"""The folder that driver and executors share, for checkpoints and tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _set_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """A new path, not yet made, in the shared folder."""
    _set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written between the jobs of one operator, and removed as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again: lineage is cut, and its size is known to the planner."""
        path = shared_folder(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((table, path))
        return table

    def tables(self) -> list[DataFrame]:
        return [t for t, _ in self.kept]

    def drop(self, *tables: DataFrame) -> None:
        for _, path in [k for k in self.kept if any(k[0] is t for t in tables)]:
            self.remove(path)
        self.kept = [k for k in self.kept if not any(k[0] is t for t in tables)]

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[t for t in self.tables() if not any(t is x for x in tables)])

    def remove(self, path: str) -> None:
        """Delete a folder that a job wrote."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
