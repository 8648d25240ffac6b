"""Folds over groups in order, for results that depend on all rows before.

A group's rows stream through one task in order, batch by batch; only the state is held. Where the steps of a part of a group can be summed up as a
function of the state before it, as those of page packing can, groups are cut into parts first (`summed_up`), and only the sums are folded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_groups(df: DataFrame, group: list[str], order: list[str], inputs: list[str], start: object, step: Callable[..., tuple], out: str, out_type: T.DataType) -> DataFrame:
    """df with the column `out`: step(state, *inputs) gives (state, value) for each row of a group, from start on."""
    arranged = df.repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(out, out_type)])
    arrow = to_arrow_schema(schema)
    key_at, in_at = ([df.columns.index(c) for c in cols] for cols in (group, inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start
        for batch in batches:
            rows = zip(zip(*[batch.column(i).to_pylist() for i in key_at], strict=True), zip(*[batch.column(i).to_pylist() for i in in_at], strict=True), strict=True)
            values = []
            for key, args in rows:
                if key != last:
                    last, state = key, start
                state, value = step(state, *args)
                values.append(value)
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, arrow.field(out).type)], schema=arrow)

    return arranged.mapInArrow(run, schema)


def summed_up(df: DataFrame, part: list[str], order: list[str], value: str, sums: Callable[[np.ndarray], tuple], ddl: str) -> DataFrame:
    """(part columns, ddl): sums(values) of each part's values (whole numbers, null as 0), in order. A task holds one part's values."""
    arranged = df.select(*part, *[c for c in order if c not in part], value).repartition(*part).sortWithinPartitions(*part, *order).select(*part, value)
    schema = T.StructType([*arranged.schema.fields[:-1], *T.StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            row = (*key, *sums(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(part))], strict=True))
            values = batch.column(len(part)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if key is not None and keys[at] != key:
                    yield done()
                    held = []
                key = keys[at]
                held.append(values[at:end])
                at = end
        if key is not None:
            yield done()

    return arranged.mapInArrow(run, schema)
