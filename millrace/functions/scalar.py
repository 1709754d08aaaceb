"""Scalar functions with fixed semantics on top of ANSI Spark.

Integers are checked at their own width and division truncates; floats follow
IEEE 754 and never fail.  Null in is null out except for the null tests.
Comparisons take Spark's order of floats (-0.0 equals 0.0, NaN is largest);
``total_order=True`` puts -0.0 before 0.0.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RAISED, ErrorKind
from ..types import BOOLEAN, NULL, UINT64, Type
from .expr import Expr, boolean, invalid, require_ansi, same_type, unsupported, whole


def _raise(kind: ErrorKind, type: Type) -> Column:
    return F.raise_error(F.lit(RAISED[kind])).cast(type.spark)


def in_range(c: Column, type: Type) -> Column:
    """``c`` as an unsigned ``type``, or an overflow."""
    outside = (c < whole(type.low)) | (c > whole(type.high))
    return F.when(outside, _raise(ErrorKind.ARITHMETIC_OVERFLOW, type)).otherwise(c.cast(type.spark))


def _numeric(what: str, *args: Expr) -> Type:
    require_ansi()
    kind = same_type(what, *args)
    if not kind.numeric:
        raise invalid(f"{what} is not defined for {kind}")
    return kind


def _made(c: Column, type: Type, *args: Expr) -> Expr:
    return Expr(c, type, any(a.nullable for a in args))


def _arithmetic(what: str, op, a: Expr, b: Expr) -> Expr:
    kind = _numeric(what, a, b)
    c = op(a.column, b.column)
    if kind.unsigned:
        c = in_range(c, kind)
    return _made(c, kind, a, b)


def add(a: Expr, b: Expr) -> Expr:
    return _arithmetic("add", operator.add, a, b)


def subtract(a: Expr, b: Expr) -> Expr:
    return _arithmetic("subtract", operator.sub, a, b)


def multiply(a: Expr, b: Expr) -> Expr:
    return _arithmetic("multiply", operator.mul, a, b)


def negative_zero(c: Column) -> Column:
    return (c == 0) & (c.cast("string") == "-0.0")


def _ieee_divide(a: Column, b: Column, type: Type) -> Column:
    lit = lambda v: F.lit(v).cast(type.spark)
    zero = F.when(F.isnan(a) | (a == 0), lit(float("nan"))).when((a < 0) != negative_zero(b), lit(float("-inf"))).otherwise(lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), lit(None)).when(b != 0, (a / b).cast(type.spark)).otherwise(zero)


def divide(a: Expr, b: Expr) -> Expr:
    """Integers truncate and fail on zero and on least / -1; floats give infinities and NaN."""
    kind = _numeric("divide", a, b)
    x, y = a.column, b.column
    if kind.floating:
        c = _ieee_divide(x, y, kind)
    elif kind == UINT64:
        c = ((x - x % y) / y).cast(kind.spark)
    else:
        c = F.call_function("div", x, y).cast(kind.spark)
        if not kind.unsigned:
            c = F.when(y == -1, -x).otherwise(c)
    return _made(c, kind, a, b)


def remainder(a: Expr, b: Expr) -> Expr:
    """The sign is the dividend's; integers fail on zero, floats give NaN."""
    kind = _numeric("remainder", a, b)
    x, y = a.column, b.column
    c = x % y
    if kind.floating:
        lit = lambda v: F.lit(v).cast(kind.spark)
        c = F.when(x.isNull() | y.isNull(), lit(None)).when(y != 0, c).otherwise(lit(float("nan")))
    return _made(c.cast(kind.spark), kind, a, b)


def negate(a: Expr) -> Expr:
    kind = _numeric("negate", a)
    if kind.unsigned:
        raise invalid(f"negate is not defined for {kind}")
    return _made(-a.column, kind, a)


def total_key(c: Column) -> Column:
    """A value that groups and orders floats with -0.0 apart from and before 0.0."""
    return F.struct(c.alias("value"), (~negative_zero(c)).alias("plain"))


def _operands(what: str, a: Expr, b: Expr, total_order: bool) -> tuple[Column, Column]:
    kind = same_type(what, a, b)
    if total_order and kind.floating:
        keyed = lambda x: F.when(x.isNotNull(), total_key(x))
        return keyed(a.column), keyed(b.column)
    return a.column, b.column


def _compare(what: str, op):
    def compare(a: Expr, b: Expr, total_order: bool = False) -> Expr:
        x, y = _operands(what, a, b, total_order)
        if a.type == NULL:
            return Expr(F.lit(None).cast("boolean"), BOOLEAN, True)
        return _made(op(x, y), BOOLEAN, a, b)

    compare.__name__ = what
    return compare


equal = _compare("equal", operator.eq)
not_equal = _compare("not_equal", operator.ne)
less = _compare("less", operator.lt)
less_or_equal = _compare("less_or_equal", operator.le)
greater = _compare("greater", operator.gt)
greater_or_equal = _compare("greater_or_equal", operator.ge)


def is_null(a: Expr) -> Expr:
    return Expr(a.column.isNull(), BOOLEAN, False)


def is_not_null(a: Expr) -> Expr:
    return Expr(a.column.isNotNull(), BOOLEAN, False)


def is_not_distinct_from(a: Expr, b: Expr, total_order: bool = False) -> Expr:
    x, y = _operands("is_not_distinct_from", a, b, total_order)
    return Expr(x.eqNullSafe(y), BOOLEAN, False)


def is_distinct_from(a: Expr, b: Expr, total_order: bool = False) -> Expr:
    return Expr(~is_not_distinct_from(a, b, total_order).column, BOOLEAN, False)


def all_of(*args: Expr) -> Expr:
    """Three-valued AND of any number of arguments; true of none."""
    boolean("all_of", *args)
    return Expr(functools.reduce(operator.and_, (a.column for a in args), F.lit(True)), BOOLEAN, any(a.nullable for a in args))


def any_of(*args: Expr) -> Expr:
    """Three-valued OR of any number of arguments; false of none."""
    boolean("any_of", *args)
    return Expr(functools.reduce(operator.or_, (a.column for a in args), F.lit(False)), BOOLEAN, any(a.nullable for a in args))


def strict(result: Expr, *args: Expr) -> Expr:
    """``result`` after each argument has been computed, so that none of their errors is skipped.

    Spark may leave out arguments that don't matter any more, as in FALSE AND x.
    An array of all arguments is made first, and its size looked at.
    """
    if not args:
        return result
    seen = F.size(F.array(*(a.column.cast("string") for a in args)))
    return Expr(F.when(seen >= 0, result.column), result.type, result.nullable)


def not_(a: Expr) -> Expr:
    boolean("not_", a)
    return _made(~a.column, BOOLEAN, a)


def case(branches: list[tuple[Expr, Expr]], otherwise: Expr) -> Expr:
    """The first branch whose condition is true, else ``otherwise``; other branches are not computed."""
    boolean("case", *(w for w, _ in branches))
    kind = same_type("case", otherwise, *(t for _, t in branches))
    if not branches:
        return otherwise
    c = F
    for when, then in branches:
        c = c.when(when.column, then.column)
    return Expr(c.otherwise(otherwise.column), kind, otherwise.nullable or any(t.nullable for _, t in branches))


def coalesce(*args: Expr) -> Expr:
    """The first argument that is not null; later ones are not computed."""
    if not args:
        raise invalid("coalesce needs an argument")
    kind = same_type("coalesce", *args)
    used = []
    for a in args:
        used.append(a)
        if not a.nullable:
            break
    return Expr(F.coalesce(*(a.column for a in used)), kind, all(a.nullable for a in used))


def raise_if(predicate: Expr, kind: ErrorKind, otherwise: Expr) -> Expr:
    """``otherwise``, failing with an error of ``kind`` on rows whose predicate is true."""
    boolean("raise_if", predicate)
    if kind not in RAISED:
        raise unsupported(f"rows don't raise {kind.value}")
    return Expr(F.when(predicate.column, _raise(kind, otherwise.type)).otherwise(otherwise.column), otherwise.type, otherwise.nullable)


def assert_not_null(a: Expr) -> Expr:
    """``a``, failing on a null."""
    if a.type == NULL:
        raise unsupported("a null column holds nothing but nulls")
    return replace(raise_if(is_null(a), ErrorKind.INVALID_INPUT, a), nullable=False)
