"""Logical types, and how Spark carries them.

Spark has no unsigned integers: those ride in the next wider type, and
whatever computes them checks the range.  Nanosecond timestamps ride as
longs, since Spark's have microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import ErrorKind, PlanError


@dataclass(frozen=True)
class Type:
    name: str
    spark: T.DataType
    low: int | None = None
    high: int | None = None

    @property
    def integer(self) -> bool:
        return self.low is not None

    @property
    def unsigned(self) -> bool:
        return self.low == 0

    @property
    def floating(self) -> bool:
        return self.name in ("float32", "float64")

    @property
    def numeric(self) -> bool:
        return self.integer or self.floating

    @property
    def text(self) -> bool:
        return self.name == "utf8"

    @property
    def temporal(self) -> bool:
        return self.name in ("date", "timestamp", "timestamp_tz", "timestamp_ns")

    def __str__(self) -> str:
        return self.name


NULL = Type("null", T.NullType())
BOOLEAN = Type("boolean", T.BooleanType())
INT8 = Type("int8", T.ByteType(), -(1 << 7), (1 << 7) - 1)
INT16 = Type("int16", T.ShortType(), -(1 << 15), (1 << 15) - 1)
INT32 = Type("int32", T.IntegerType(), -(1 << 31), (1 << 31) - 1)
INT64 = Type("int64", T.LongType(), -(1 << 63), (1 << 63) - 1)
UINT8 = Type("uint8", T.ShortType(), 0, (1 << 8) - 1)
UINT16 = Type("uint16", T.IntegerType(), 0, (1 << 16) - 1)
UINT32 = Type("uint32", T.LongType(), 0, (1 << 32) - 1)
UINT64 = Type("uint64", T.DecimalType(20, 0), 0, (1 << 64) - 1)
FLOAT32 = Type("float32", T.FloatType())
FLOAT64 = Type("float64", T.DoubleType())
UTF8 = Type("utf8", T.StringType())
BINARY = Type("binary", T.BinaryType())
DATE = Type("date", T.DateType())
TIMESTAMP = Type("timestamp", T.TimestampNTZType())
TIMESTAMP_TZ = Type("timestamp_tz", T.TimestampType())
TIMESTAMP_NS = Type("timestamp_ns", T.LongType())

SIGNED = (INT8, INT16, INT32, INT64)
UNSIGNED = (UINT8, UINT16, UINT32, UINT64)
FLOATS = (FLOAT32, FLOAT64)
NUMERIC = SIGNED + UNSIGNED + FLOATS
SUPPORTED = (NULL, BOOLEAN, *NUMERIC, UTF8, BINARY, DATE, TIMESTAMP, TIMESTAMP_TZ, TIMESTAMP_NS)

#: The type of a column that comes without one: Spark's own, unsigned only on demand.
_DEFAULT = {t.spark: t for t in (NULL, BOOLEAN, *SIGNED, *FLOATS, UTF8, BINARY, DATE, TIMESTAMP, TIMESTAMP_TZ, UINT64)}


def type_of(spark: T.DataType) -> Type:
    """The logical type of a Spark type; lists, maps, structs and other decimals have none."""
    if spark in _DEFAULT:
        return _DEFAULT[spark]
    if isinstance(spark, (T.VarcharType, T.CharType)):
        return UTF8
    raise PlanError(ErrorKind.UNSUPPORTED, f"no logical type for {spark.simpleString()}")
