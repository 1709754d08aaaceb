"""Aggregate functions with fixed semantics, as columns for ``groupBy().agg()``.

Sums of integers wrap at 64 bits; sums, averages and covariances take what
casts and skip what doesn't.  A FILTER keeps rows from an aggregate and from
the errors of its argument, but not from their group.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOAT64, INT64, NULL, UINT64, Type
from .casts import try_cast
from .expr import Expr, boolean, invalid, unsupported
from .scalar import total_key

COUNT, SUM, AVG, MIN, MAX, COVAR_POP = "count", "sum", "avg", "min", "max", "covar_pop"
_ARGUMENTS = {COUNT: (0, 1), SUM: (1,), AVG: (1,), MIN: (1,), MAX: (1,), COVAR_POP: (2,)}


@dataclass(frozen=True)
class Aggregate:
    """``function(*args)`` with result type ``type``; ``total_order`` tells -0.0 from 0.0 in DISTINCT, MIN and MAX."""

    function: str
    args: tuple[Expr, ...] = ()
    type: Type = INT64
    distinct: bool = False
    predicate: Expr | None = field(default=None)
    total_order: bool = False

    def __post_init__(self):
        f, args = self.function, self.args
        if f not in _ARGUMENTS:
            raise unsupported(f"no aggregate {f}")
        if len(args) not in _ARGUMENTS[f] or (self.distinct and not args):
            raise invalid(f"{f} does not take {len(args)} arguments" + " with DISTINCT" * self.distinct)
        if self.distinct and f != COUNT:
            raise unsupported(f"no DISTINCT in {f}")
        if f == COUNT and self.type != INT64:
            raise invalid(f"count is int64, not {self.type}")
        if f == SUM and self.type not in (INT64, UINT64, FLOAT64):
            raise unsupported(f"no sum as {self.type}")
        if f in (AVG, COVAR_POP) and self.type != FLOAT64:
            raise invalid(f"{f} is float64, not {self.type}")
        if f in (MIN, MAX) and self.type != args[0].type:
            raise invalid(f"{f} of {args[0].type} is not {self.type}")
        if f in (SUM, AVG, COVAR_POP) and any(a.type.temporal for a in args):
            raise unsupported(f"no {f} of dates and times")
        if self.predicate is not None:
            boolean("filter", self.predicate)

    def where(self, predicate: Expr) -> Aggregate:
        return replace(self, predicate=predicate)

    def _seen(self, c: Column) -> Column:
        return c if self.predicate is None else F.when(self.predicate.column, c)

    def column(self) -> Column:
        f, args = self.function, self.args
        if f == COUNT:
            if not args:
                return F.count(self._seen(F.lit(1)))
            a = args[0]
            if a.type == NULL:
                return F.count(F.lit(None).cast("int"))
            c = a.column
            if self.distinct and self.total_order and a.type.floating:
                c = F.when(c.isNotNull(), total_key(c))
            return F.count_distinct(self._seen(c)) if self.distinct else F.count(self._seen(c))
        if f == SUM:
            c = self._seen(try_cast(args[0], self.type).column)
            return F.sum(c) if self.type == FLOAT64 else wrapping_sum(c, self.type)
        if f in (AVG, COVAR_POP):
            cs = [self._seen(try_cast(a, FLOAT64).column) for a in args]
            return F.avg(*cs) if f == AVG else F.covar_pop(*cs)
        c, kind = self._seen(args[0].column), args[0].type
        pick = F.min if f == MIN else F.max
        if self.total_order and kind.floating:
            best = pick(F.when(c.isNotNull(), total_key(c)))
            return F.when(best["plain"], best["value"]).otherwise(F.when(best["value"].isNotNull(), F.lit(-0.0).cast(kind.spark)))
        return pick(c)


def wrapping_sum(c: Column, type: Type) -> Column:
    """The sum modulo 2**64.

    A long is summed as three parts of 22, 22 and 20 bits, which stay longs for
    2**41 rows; decimals, which are slow, come in once per group.  An unsigned
    number is summed as the long of the same bits.
    """
    wide = lambda x: x.cast("decimal(38,0)")
    power = lambda n: F.lit(Decimal(1 << n))
    if type == UINT64:
        c = c.cast("decimal(20,0)")
        c = F.when(c >= power(63), c - power(64)).otherwise(c)
    c = c.cast("bigint")
    mask = F.lit((1 << 22) - 1).cast("bigint")
    low, mid, high = F.sum(c.bitwiseAND(mask)), F.sum(F.shiftright(c, 22).bitwiseAND(mask)), F.sum(F.shiftright(c, 44))
    total = wide(low) + wide(mid) * power(22) + wide(high) * power(44)
    if type == UINT64:
        return F.pmod(wide(total), power(64)).cast(type.spark)
    return (F.pmod(wide(total) + power(63), power(64)) - power(63)).cast("bigint")


def count(x: Expr | None = None, distinct: bool = False, total_order: bool = False) -> Aggregate:
    return Aggregate(COUNT, () if x is None else (x,), INT64, distinct, total_order=total_order)


def sum_(x: Expr, type: Type = INT64) -> Aggregate:
    return Aggregate(SUM, (x,), type)


def avg(x: Expr) -> Aggregate:
    return Aggregate(AVG, (x,), FLOAT64)


def min_(x: Expr, total_order: bool = False) -> Aggregate:
    return Aggregate(MIN, (x,), x.type, total_order=total_order)


def max_(x: Expr, total_order: bool = False) -> Aggregate:
    return Aggregate(MAX, (x,), x.type, total_order=total_order)


def covar_pop(x: Expr, y: Expr) -> Aggregate:
    return Aggregate(COVAR_POP, (x, y), FLOAT64)
