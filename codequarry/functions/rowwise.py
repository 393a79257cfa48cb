"""Kernels over rows in Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Rows whose results are in memory at once.
SLICE = 128

#: Name of the new column, kernel, type of its result, and the columns that it takes.
Kernel = tuple[str, Callable, str, tuple[str, ...]]


def spread(df: DataFrame) -> DataFrame:
    """Rows in at least as many tasks as the cluster runs at once; a plan that has so many partitions is left as it is.

    A kernel takes milliseconds a row whose bytes are few. A small input comes in a few partitions of many rows, so it is dealt out; its rows are few, and so is what is
    shuffled. A large scan keeps its own splits: nothing is shuffled, however many there are, and ``spark.sql.files.maxPartitionBytes`` makes them smaller. Where
    the number is open until a shuffle has run, rows go to the partitions that are asked for, which adaptive execution then doesn't merge. A stream keeps the splits of its files:
    what it shuffles stays on disk from batch to batch.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if not plan.toString().startswith("AdaptiveSparkPlan") and plan.execute().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores))


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Trees and rows have no reference cycles, so looking for some in each of them, nearly half the time of parsing, is put off to the end of a slice."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_kernels(df: DataFrame, *kernels: Kernel, without: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """``df`` and a column for each kernel, all computed in one step over rows that are spread evenly, or are ``dealt`` out so already; columns in ``without`` aren't sent back.

    The step is opaque to the optimizer, so a kernel runs once a row even under later filters; put filters that need
    no kernel, and the selection of columns, before it.
    """
    types = [DataType.fromDDL(result) for _, _, result, _ in kernels]
    carried = [c for c in df.columns if c not in without]
    schema = StructType([*(df.schema[c] for c in carried), *(StructField(k[0], t) for k, t in zip(kernels, types, strict=True))])
    names, arrow = schema.fieldNames(), [to_arrow_type(t) for t in types]
    calls = [(kernel, [df.columns.index(c) for c in inputs]) for _, kernel, _, inputs in kernels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), SLICE):
                part = batch.slice(at, SLICE)
                made = []
                with _no_cycles():
                    for (kernel, places), kind in zip(calls, arrow, strict=True):
                        made.append(pa.array([kernel(*row) for row in zip(*(part.column(k).to_pylist() for k in places), strict=True)], kind))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *made], names)

    return (df if dealt else spread(df)).mapInArrow(run, schema)


def with_kernel(df: DataFrame, name: str, kernel: Callable, result: str, *inputs: str, without: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """``df`` and one column of ``kernel(*inputs)``."""
    return with_kernels(df, (name, kernel, result, inputs), without=without, dealt=dealt)
