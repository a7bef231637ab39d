"""Arrow batch plumbing for operators that built-in expressions cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship

#: Rows a Python worker takes at a time, so that its memory does not follow the batch setting.
SLICE_ROWS = 2000


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn`` from a batch to a dict of columns (lists or arrays), or None for no rows.

    A column named in ``schema`` must be in the dict; batches are cut to ``SLICE_ROWS`` rows.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS))
                if out is None:
                    continue
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return spread(df).mapInArrow(run, schema)


def map_partition(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn`` from a task's whole iterator of batches to dicts of columns."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return spread(df).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it is a plain scan of so few splits that most cores would idle.

    That happens with small files of one row group; a scan of many splits is left alone, as is any plan that shuffles.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores / 2 else df


def _struct(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
