"""A source whose tasks are described by the host: each yields Arrow batches.

    spark.dataSource.register(TaskSource)
    spark.read.format("tasks").option("reader", "package.module:function").option("tasks", json).schema(...).load()

``tasks`` is a JSON list; Spark reads each entry as a partition of its own by
``function(task, columns)``, which yields ``pyarrow.RecordBatch``.  A task may
be read again, after a failure or by another run.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Task(InputPartition):
    def __init__(self, body):
        super().__init__(body)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.reader = schema.names, options["reader"]
        self.tasks = json.loads(options.get("tasks", "[]"))

    def partitions(self) -> list[_Task]:
        return [_Task(t) for t in self.tasks]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no tasks at all
            return
        for batch in load(self.reader)(partition.value, self.columns):
            yield batch.select(self.columns)


def load(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class TaskSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tasks"

    def schema(self) -> StructType:
        raise ValueError("give the schema with .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def parquet_task(task: dict, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A reader of row groups: ``{"path": ..., "row_groups": [...]}``, all row groups by default."""
    import pyarrow.parquet as pq

    file = pq.ParquetFile(task["path"])
    yield from file.iter_batches(row_groups=task.get("row_groups"), columns=list(columns))
