"""Sources, sinks, streams, cancellation and plans."""

from __future__ import annotations

import json
import threading
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from millrace import functions as M
from millrace import types as T
from millrace.errors import ErrorKind
from millrace.operators.relational import aggregate, filter_rows, scan
from millrace.operators.runs import RunError, cancel, classified, first_rows, tagged
from millrace.sources.memory import from_arrow, from_rows
from millrace.sources.sinks import consume, to_arrow, write_parquet
from millrace.sources.tasks import TaskSource
from millrace.streaming import run_available, stream_parquet


def test_pushdown_and_pruning(spark, sf):
    df = scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    plan = filter_rows(df, M.greater(M.reference(df, "l_quantity"), M.constant(45.0, T.FLOAT64)), ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_task_source(spark, sf, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"a": list(range(100)), "b": ["x"] * 100}), path, row_group_size=25)
    spark.dataSource.register(TaskSource)
    tasks = [{"path": path, "row_groups": [k]} for k in range(4)]
    df = spark.read.format("tasks").option("reader", "millrace.sources.tasks:parquet_task").option("tasks", json.dumps(tasks)).schema("a bigint").load()
    assert df.rdd.getNumPartitions() == 4
    for _ in range(2):  # a task can be read again
        assert sorted(r.a for r in df.collect()) == list(range(100))
    none = spark.read.format("tasks").option("reader", "millrace.sources.tasks:parquet_task").schema("a bigint").load()
    assert none.count() == 0


def test_memory_and_sinks(spark, tmp_path):
    df = from_rows(spark, [(1, "a"), (2, None)], "n int, s string")
    assert to_arrow(df).num_rows == 2
    write_parquet(df, str(tmp_path / "out"), partition_by=("n",))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(RunError):
        write_parquet(df, str(tmp_path / "out"))
    assert consume(df, lambda b: None) == 2
    assert from_arrow(spark, pa.table({"x": [1.5, None]})).count() == 2
    assert len(first_rows(spark.range(1000), 3)) == 3


def test_failed_read_has_a_kind(spark, tmp_path):
    with pytest.raises(RunError) as e, classified():
        scan(spark, str(tmp_path / "missing"))
    assert e.value.kind is ErrorKind.EXTERNAL


def test_cancellation(spark):
    over = threading.Event()

    def later():
        while not over.wait(1):  # the job may not have begun yet
            cancel(spark, "slow")

    t = threading.Thread(target=later, daemon=True)
    t.start()
    with pytest.raises(RunError) as e, tagged(spark, "slow"), classified():
        spark.range(0, 8, 1, 4).mapInArrow(lambda it: (time.sleep(20), iter(it))[1], "id long").count()
    over.set()
    t.join()
    assert e.value.kind is ErrorKind.CANCELLED


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, k * 10), (k, 1)], "g int, v bigint").write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    df = stream_parquet(spark, str(tmp_path / "in"), schema)
    out: dict = {}
    totals = aggregate(df, {"g": M.reference(df, "g")}, {"s": M.sum_(M.reference(df, "v"))})
    run_available(totals, lambda batch, k: out.update({r.g: r.s for r in batch.collect()}), str(tmp_path / "ck"), "update")
    assert out == {0: 1, 1: 11, 2: 21}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
