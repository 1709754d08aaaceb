"""Small tables from rows or Arrow, with a schema that is given and not inferred."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def from_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)
