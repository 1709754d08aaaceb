"""Typed scalar functions, casts and aggregates."""

from .aggregates import Aggregate, avg, count, covar_pop, max_, min_, sum_, wrapping_sum
from .casts import cast, try_cast
from .expr import Expr, constant, null, reference
from .scalar import (
    add, all_of, any_of, assert_not_null, case, coalesce, divide, equal, greater, greater_or_equal, is_distinct_from, is_not_distinct_from,
    is_not_null, is_null, less, less_or_equal, multiply, negate, not_, not_equal, raise_if, remainder, strict, subtract, total_key,
)

__all__ = [
    "Aggregate", "Expr", "add", "all_of", "any_of", "assert_not_null", "avg", "case", "cast", "coalesce", "constant", "count", "covar_pop", "divide", "equal",
    "greater", "greater_or_equal", "is_distinct_from", "is_not_distinct_from", "is_not_null", "is_null", "less", "less_or_equal", "max_", "min_", "multiply",
    "negate", "not_", "not_equal", "null", "raise_if", "reference", "remainder", "strict", "subtract", "sum_", "total_key", "try_cast", "wrapping_sum",
]
