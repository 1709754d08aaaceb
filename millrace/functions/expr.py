"""Typed expressions: a Spark column with a logical type, checked as it is put together."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ErrorKind, PlanError
from ..types import BOOLEAN, NULL, Type, type_of


@dataclass(frozen=True)
class Expr:
    column: Column
    type: Type
    nullable: bool = True

    def named(self, name: str) -> Column:
        return self.column.alias(name)


def invalid(message: str) -> PlanError:
    return PlanError(ErrorKind.INVALID_PLAN, message)


def unsupported(message: str) -> PlanError:
    return PlanError(ErrorKind.UNSUPPORTED, message)


def require_ansi(spark: SparkSession | None = None) -> None:
    """Fail as a plan is put together in a session without ANSI mode, on which checked arithmetic and strict casts depend."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and str(spark.conf.get("spark.sql.ansi.enabled")).lower() != "true":
        raise unsupported("spark.sql.ansi.enabled is off")


def reference(df: DataFrame, name: str, type: Type | None = None) -> Expr:
    """A column of ``df``. ``type`` is for columns that carry an unsigned integer or nanoseconds."""
    if name not in df.columns:
        raise invalid(f"no column {name}")
    field = df.schema[name]
    if type is not None and type.spark != field.dataType:
        raise invalid(f"{name} is {field.dataType.simpleString()}, which carries no {type}")
    return Expr(df[name], type or type_of(field.dataType), field.nullable)


def constant(value, type: Type) -> Expr:
    """A literal of a logical type, or its null."""
    if type.integer and value is not None and not type.low <= value <= type.high:
        raise invalid(f"{value} is no {type}")
    return Expr((whole(value) if type.integer and value is not None else F.lit(value)).cast(type.spark), type, value is None)


def whole(value: int) -> Column:
    """A whole number of any size as a literal; beyond 64 bits signed it is a decimal."""
    return F.lit(value if -(1 << 63) <= value < 1 << 63 else Decimal(value))


def null(type: Type = NULL) -> Expr:
    return Expr(F.lit(None).cast(type.spark), type, True)


def same_type(what: str, *args: Expr) -> Type:
    """The one type of all operands; nothing is coerced."""
    kinds = {a.type for a in args}
    if len(kinds) != 1:
        raise invalid(f"{what} needs operands of one type, not {', '.join(str(a.type) for a in args)}; insert a cast")
    return args[0].type


def boolean(what: str, *args: Expr) -> None:
    for a in args:
        if a.type not in (BOOLEAN, NULL):
            raise invalid(f"{what} needs a boolean, not {a.type}")
