"""Kinds of errors, of plans and of runs."""

from __future__ import annotations

import enum
import re


class ErrorKind(enum.Enum):
    INVALID_PLAN = "invalid plan"
    UNSUPPORTED = "unsupported"
    INVALID_INPUT = "invalid input"
    ARITHMETIC_OVERFLOW = "arithmetic overflow"
    DIVISION_BY_ZERO = "division by zero"
    CANCELLED = "cancelled"
    RESOURCE_EXHAUSTED = "resource exhausted"
    UNAVAILABLE = "unavailable"
    EXTERNAL = "external"
    TASK_FAILED = "task failed"
    INTERNAL = "internal"


class PlanError(Exception):
    """A plan that can't be built; raised before anything runs."""

    def __init__(self, kind: ErrorKind, message: str):
        super().__init__(f"{kind.value}: {message}")
        self.kind = kind


#: Texts that ``raise_error`` puts into a failing row, by kind.
RAISED = {ErrorKind.ARITHMETIC_OVERFLOW: "millrace: arithmetic overflow", ErrorKind.DIVISION_BY_ZERO: "millrace: division by zero", ErrorKind.INVALID_INPUT: "millrace: invalid input"}

# Spark's error conditions by kind, as it names them.
_CONDITIONS = {
    ErrorKind.ARITHMETIC_OVERFLOW: ("ARITHMETIC_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE"),
    ErrorKind.DIVISION_BY_ZERO: ("DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO"),
    ErrorKind.INVALID_INPUT: ("CAST_INVALID_INPUT", "CAST_OVERFLOW", "INVALID_UTF8_STRING", "NOT_NULL_ASSERT_VIOLATION"),
    ErrorKind.INVALID_PLAN: ("DATATYPE_MISMATCH", "UNRESOLVED_COLUMN", "MISSING_AGGREGATION"),
    ErrorKind.UNSUPPORTED: ("UNSUPPORTED_FEATURE",),
    ErrorKind.EXTERNAL: ("FAILED_READ_FILE", "PATH_NOT_FOUND"),
    ErrorKind.RESOURCE_EXHAUSTED: ("UNABLE_TO_ACQUIRE_MEMORY",),
}
_BY_CONDITION = {c: k for k, names in _CONDITIONS.items() for c in names}


def kind_of(error: BaseException) -> ErrorKind:
    """The kind of whatever a plan or its run has raised."""
    if isinstance(error, PlanError):
        return error.kind
    text = str(error)
    for kind, said in RAISED.items():
        if said in text:
            return kind
    condition = getattr(error, "getCondition", lambda: None)()
    found = [condition] if condition else []
    found += re.findall(r"\[([A-Z][A-Z0-9_.]+)\]", text)
    for c in found:
        if (kind := _BY_CONDITION.get(c.split(".")[0])) is not None:
            return kind
    if re.search(r"cancelled|SparkJobCancelled|SPARK_JOB_CANCELLED", text, re.I):
        return ErrorKind.CANCELLED
    if "SparkException" in text and "Task" in text:
        return ErrorKind.TASK_FAILED
    return ErrorKind.INTERNAL
