"""Scan, filter, project and aggregate, as transforms of DataFrames.

Catalyst plans them: predicates and columns reach the scan, aggregation
combines before its shuffle.  Each transform also runs on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate
from ..functions.expr import Expr, boolean, invalid
from ..functions.scalar import total_key
from ..types import BOOLEAN


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, format: str = "parquet") -> DataFrame:
    """Named columns of a stored table, in the order given; all of them by default."""
    df = spark.read.format(format).load(path)
    if columns is None:
        return df
    for c in columns:
        if c not in df.columns:
            raise invalid(f"no column {c}")
    return df.select(*columns)


def filter_rows(df: DataFrame, predicate: Expr, outputs: Sequence[str] | None = None) -> DataFrame:
    """Rows whose predicate is true; false and null drop. ``outputs``: the columns to keep."""
    boolean("filter", predicate)
    kept = df.filter(predicate.column.cast("boolean") if predicate.type != BOOLEAN else predicate.column)
    return kept if outputs is None else kept.select(*outputs)


def project(df: DataFrame, columns: Mapping[str, Expr]) -> DataFrame:
    """One column per expression; without any, the rows stay as rows of no columns."""
    return df.select(*(e.column.alias(name) for name, e in columns.items()))


def aggregate(df: DataFrame, groups: Mapping[str, Expr], aggregates: Mapping[str, Aggregate], having: Callable[[DataFrame], Column] | None = None, total_order: bool = False) -> DataFrame:
    """Keys, then aggregates. Null is a key like any other.

    Without keys there is one row, of an empty input too; without aggregates
    the keys come once each.  ``total_order`` keeps float keys -0.0 and 0.0
    apart.  ``having`` gives a condition on the result.
    """
    if not groups and not aggregates:
        raise invalid("an aggregate needs keys or functions")
    results = [a.column().alias(name) for name, a in aggregates.items()]
    if not groups:
        out = df.agg(*results)
    else:
        split = {name for name, e in groups.items() if total_order and e.type.floating}
        keys = [(F.when(e.column.isNotNull(), total_key(e.column)) if name in split else e.column).alias(name) for name, e in groups.items()]
        # Spark stores -0.0 as 0.0 in a key; the flag beside it says what it was
        back = [F.when(F.col(n)["plain"], F.col(n)["value"]).when(F.col(n).isNotNull(), F.lit(-0.0).cast(groups[n].type.spark)).alias(n) if n in split else F.col(n) for n in groups]
        out = (df.groupBy(*keys).agg(*results) if results else df.select(*keys).distinct()).select(*back, *aggregates)
    return out if having is None else out.filter(having(out))


def distinct(df: DataFrame, keys: Mapping[str, Expr], total_order: bool = False) -> DataFrame:
    return aggregate(df, keys, {}, total_order=total_order)


def custom(children: Sequence[DataFrame], arity: int, run: Callable[..., DataFrame]) -> DataFrame:
    """An operator of the caller's own over ``arity`` inputs."""
    if len(children) != arity:
        raise invalid(f"the operator takes {arity} inputs, not {len(children)}")
    return run(*children)
