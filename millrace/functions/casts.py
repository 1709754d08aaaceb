"""Casts between logical types: strict ones fail on a value that doesn't fit, try ones give null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import RAISED, ErrorKind
from ..types import BINARY, BOOLEAN, FLOAT32, NULL, UINT64, UTF8, Type
from .expr import Expr, require_ansi, unsupported, whole

# Words for true and false, and the text of numbers.
TRUE = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
FALSE = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")
INTEGER, NATURAL = r"^[+-]?[0-9]+\z", r"^[+]?[0-9]+\z"
FLOAT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
SPECIAL = r"^(?i)([+-]?)(inf|infinity|nan)\z"
#: White space that is trimmed around booleans, and around nothing else.
AROUND = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"


@F.pandas_udf(StringType())
def _float64_text(x: pd.Series) -> pd.Series:
    return x.map(_shortest)


@F.pandas_udf(StringType())
def _float32_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _shortest(np.float32(v)))


def _shortest(v) -> str:
    """The shortest digits that read back as the same number, without an exponent."""
    if np.isnan(v):
        return "NaN"
    if np.isinf(v):
        return "inf" if v > 0 else "-inf"
    return np.format_float_positional(v, unique=True, trim="-")


def _guarded(ok: Column, value: Column, to: Type, strict: bool, seen: Column) -> Column:
    """``value`` where ``ok``; elsewhere a failure that quotes the input, or null; null stays null."""
    bad = F.raise_error(F.concat(F.lit(RAISED[ErrorKind.INVALID_INPUT] + ": invalid scalar cast: '"), seen, F.lit("'"))).cast(to.spark) if strict else F.lit(None).cast(to.spark)
    return F.when(seen.isNull(), F.lit(None).cast(to.spark)).when(ok, value).otherwise(bad)


def _within(c: Column, to: Type) -> Column:
    """Whether a float truncates to a value of ``to``."""
    below = float(to.low) - 1.0 if to.low > -(1 << 52) else float(np.nextafter(float(to.low), -np.inf))
    return (c > F.lit(below)) & (c < F.lit(float(to.high + 1))) & ~F.isnan(c)


def _to_integer(a: Expr, to: Type, strict: bool) -> Column:
    c, kind = a.column, a.type
    if kind == BOOLEAN:
        return c.cast("int").cast(to.spark)
    if kind.text or kind == BINARY:
        s = c.cast("string")
        n = F.when(s.rlike(NATURAL if to.unsigned else INTEGER), s.try_cast("decimal(38,0)"))
        return _guarded(n.isNotNull() & n.between(whole(to.low), whole(to.high)), n.try_cast(to.spark), to, strict, s)
    if kind.floating:
        d = c.cast("double")
        # longs hold the lower half of uint64; above, a double is whole
        value = F.when(d < 2.0**63, d.try_cast("bigint").cast(to.spark)).otherwise(d.try_cast(to.spark)) if to == UINT64 else d.try_cast(to.spark)
        return _guarded(_within(d, to), value, to, strict, c.cast("string"))
    return _guarded(c.between(whole(to.low), whole(to.high)), c.try_cast(to.spark), to, strict, c.cast("string"))


def _to_float(a: Expr, to: Type, strict: bool) -> Column:
    c, kind = a.column, a.type
    if kind == BOOLEAN:
        return c.cast("int").cast(to.spark)
    if kind.text or kind == BINARY:
        s = c.cast("string")
        sign = F.when(F.regexp_extract(s, SPECIAL, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
        special = F.when(F.lower(F.regexp_extract(s, SPECIAL, 2)) == "nan", F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
        value = F.when(s.rlike(SPECIAL), special.cast(to.spark)).when(s.rlike(FLOAT), s.try_cast(to.spark))
        return _guarded(s.rlike(SPECIAL) | s.rlike(FLOAT), value, to, strict, s)
    return c.cast(to.spark)


def _to_boolean(a: Expr, strict: bool) -> Column:
    c = a.column
    if a.type.text or a.type == BINARY:
        s = F.lower(F.regexp_replace(c.cast("string"), AROUND, ""))
        return _guarded(s.isin(*TRUE, *FALSE), s.isin(*TRUE), BOOLEAN, strict, c.cast("string"))
    if a.type.floating:
        return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.isnan(c) | (c != 0))
    return c != 0


def _to_text(a: Expr, strict: bool) -> Column:
    c = a.column
    if a.type == BINARY:
        s = c.cast("string")
        return F.validate_utf8(s) if strict else F.try_validate_utf8(s)
    if a.type.floating:
        text = _float32_text(c) if a.type == FLOAT32 else _float64_text(c)
        return F.when(c.isNotNull(), text)
    return c.cast("string")


def cast(a: Expr, to: Type, strict: bool = True) -> Expr:
    """``a`` as ``to``. Dates and times cast to their own type only."""
    require_ansi()
    kind = a.type
    if kind == to:
        return a
    if kind == NULL:
        return Expr(F.lit(None).cast(to.spark), to, True)
    plain = lambda t: t.numeric or t in (BOOLEAN, UTF8, BINARY)
    if not plain(kind) or not plain(to):
        raise unsupported(f"no cast from {kind} to {to}")
    if to.integer:
        c = _to_integer(a, to, strict)
    elif to.floating:
        c = _to_float(a, to, strict)
    elif to == BOOLEAN:
        c = _to_boolean(a, strict)
    elif to == UTF8:
        c = _to_text(a, strict)
    else:
        c = (a.column if kind == UTF8 else _to_text(a, strict)).cast("binary")
    return Expr(c, to, a.nullable or not strict)


def try_cast(a: Expr, to: Type) -> Expr:
    return cast(a, to, strict=False)
