"""Running plans: cancellation by name, early stop, and errors by kind."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import ErrorKind, kind_of


class RunError(Exception):
    """A run that failed, with the kind of its failure; the cause is attached."""

    def __init__(self, kind: ErrorKind, cause: BaseException):
        super().__init__(f"{kind.value}: {str(cause).splitlines()[0] if str(cause) else type(cause).__name__}")
        self.kind = kind


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be cancelled by ``tag`` from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


@contextlib.contextmanager
def classified() -> Iterator[None]:
    """Failures inside are raised again as ``RunError``, with their kind."""
    try:
        yield
    except RunError:
        raise
    except Exception as e:
        raise RunError(kind_of(e), e) from e


def first_rows(df: DataFrame, n: int) -> list[Row]:
    """At most ``n`` rows; Spark stops reading once it has them."""
    with classified():
        return df.take(n)
