"""Sinks: files, Arrow at the driver, and a function of the host's over batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.runs import classified


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    """Files appear when the whole job has succeeded."""
    with classified():
        w = df.write.mode(mode)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def to_arrow(df: DataFrame) -> pa.Table:
    """All rows at the driver; for results that are known to be small."""
    with classified():
        return df.toArrow()


def consume(df: DataFrame, each: Callable[[pa.RecordBatch], object]) -> int:
    """Run ``each`` over all batches, on the executors; the number of rows. A batch may come again if its task is retried."""

    def run(batches):
        n = 0
        for b in batches:
            each(b)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    with classified():
        return sum(r.n for r in df.mapInArrow(run, "n long").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r.n)
