"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import Scratch, checkpointed, shared_folder

__all__ = ["ROWS_AT_ONCE", "Scratch", "checkpointed", "per_text", "shared_folder", "table"]

#: Rows of an Arrow batch that are decoded to Python objects at a time.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(
    df: DataFrame,
    keep: list[str],
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[str], tuple]],
) -> DataFrame:
    """One output row per input row: the columns in keep, then the values that make()'s function gives for the text.

    Null texts are read as empty ones. Only the named columns are read, so that other columns
    of df may have any name. keep columns pass through as Arrow arrays and so stay exact.
    """
    chosen = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *fields])
    arrow = to_arrow_schema(schema)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                rows = [fn(t) for t in part.column(n_keep).to_pylist()]
                columns = list(zip(*rows, strict=True))
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(n_keep)]
                arrays += [pa.array(c, type=arrow.field(n_keep + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return chosen.mapInArrow(run, schema)
