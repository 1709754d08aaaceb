"""Semantics of functions, casts and aggregates on small tables with nulls and edge values."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest

from millrace import functions as M
from millrace import types as T
from millrace.errors import ErrorKind, PlanError
from millrace.operators.relational import aggregate, custom, distinct, filter_rows, project
from millrace.operators.runs import RunError, classified

NAN, INF = float("nan"), float("inf")


@pytest.fixture(params=["true", "false"], ids=["compiled", "interpreted"])
def mode(spark, request):
    spark.conf.set("spark.sql.codegen.wholeStage", request.param)
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "true")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("i").collect()] if "i" in df.columns else [r[column] for r in df.collect()]


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)


def run(df, e):
    return values(project(df, {"i": M.reference(df, "i"), "v": e}))


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if isinstance(y, float) and math.isnan(y):
            assert isinstance(x, float) and math.isnan(x)
        else:
            assert x == y and (not isinstance(y, float) or math.copysign(1, x) == math.copysign(1, y))


def fails(kind, f):
    with pytest.raises((PlanError, RunError)) as e:
        with classified():
            f()
    assert e.value.kind is kind


@pytest.mark.parametrize("sql,t,low,high", [("tinyint", T.INT8, -128, 127), ("smallint", T.INT16, -32768, 32767), ("int", T.INT32, -(1 << 31), (1 << 31) - 1), ("bigint", T.INT64, -(1 << 63), (1 << 63) - 1)])
def test_integers_are_checked_at_their_width(spark, mode, sql, t, low, high):
    df = frame(spark, f"a {sql}, b {sql}", [(6, 2), (3, None), (None, 2), (12, -5)])
    a, b = M.reference(df, "a"), M.reference(df, "b")
    assert run(df, M.add(a, b)) == [8, None, None, 7]
    assert run(df, M.multiply(a, b)) == [12, None, None, -60]
    assert run(df, M.divide(a, b)) == [3, None, None, -2]
    assert run(df, M.remainder(a, b)) == [0, None, None, 2]
    edge = frame(spark, f"a {sql}, b {sql}", [(low, -1)])
    a, b = M.reference(edge, "a"), M.reference(edge, "b")
    for f in (M.add, M.multiply, M.divide):
        fails(ErrorKind.ARITHMETIC_OVERFLOW, lambda f=f: run(edge, f(a, b)))
    fails(ErrorKind.ARITHMETIC_OVERFLOW, lambda: run(edge, M.negate(a)))
    assert run(edge, M.remainder(a, b)) == [0]
    zero = frame(spark, f"a {sql}, b {sql}", [(1, 0)])
    for f in (M.divide, M.remainder):
        fails(ErrorKind.DIVISION_BY_ZERO, lambda f=f: run(zero, f(M.reference(zero, "a"), M.reference(zero, "b"))))
    nulls = frame(spark, f"a {sql}, b {sql}", [(None, 0)])
    assert run(nulls, M.divide(M.reference(nulls, "a"), M.reference(nulls, "b"))) == [None]


@pytest.mark.parametrize("sql,t,high", [("smallint", T.UINT8, 255), ("int", T.UINT16, 65535), ("bigint", T.UINT32, (1 << 32) - 1), ("decimal(20,0)", T.UINT64, (1 << 64) - 1)])
def test_unsigned_integers(spark, mode, sql, t, high):
    v = Decimal if t is T.UINT64 else int
    df = frame(spark, f"a {sql}, b {sql}", [(v(high), v(1)), (v(7), v(2))])
    a, b = M.reference(df, "a", t), M.reference(df, "b", t)
    assert [int(x) for x in run(df, M.subtract(a, b))] == [high - 1, 5]
    assert [int(x) for x in run(df, M.divide(a, b))] == [high, 3]
    assert [int(x) for x in run(df, M.remainder(a, b))] == [0, 1]
    fails(ErrorKind.ARITHMETIC_OVERFLOW, lambda: run(df, M.add(a, b)))
    fails(ErrorKind.ARITHMETIC_OVERFLOW, lambda: run(df, M.subtract(b, a)))
    fails(ErrorKind.INVALID_PLAN, lambda: M.negate(a))


@pytest.mark.parametrize("sql,t", [("double", T.FLOAT64), ("float", T.FLOAT32)])
def test_floats_follow_ieee(spark, mode, sql, t):
    df = frame(spark, f"a {sql}, b {sql}", [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (6.0, 3.0), (NAN, 0.0), (None, 0.0), (1.0, None), (-INF, 0.0), (-1.0, -0.0), (1.0, NAN)])
    a, b = M.reference(df, "a"), M.reference(df, "b")
    same(run(df, M.divide(a, b)), [INF, -INF, -INF, NAN, 2.0, NAN, None, None, -INF, INF, NAN])
    same(run(df, M.remainder(a, b)), [NAN, NAN, NAN, NAN, 0.0, NAN, None, None, NAN, NAN, NAN])


def test_total_order(spark, mode):
    df = frame(spark, "a double, b double", [(-0.0, 0.0), (NAN, 1.0), (None, 1.0), (1.0, 0.0), (INF, NAN)])
    a, b = M.reference(df, "a"), M.reference(df, "b")
    assert run(df, M.less(a, b, total_order=True)) == [True, False, None, False, True]
    assert run(df, M.equal(a, b, total_order=True)) == [False, False, None, False, False]
    assert run(df, M.equal(a, b)) == [True, False, None, False, False]
    assert run(df, M.is_distinct_from(a, b, total_order=True)) == [True, True, True, True, True]
    z = frame(spark, "v double", [(-0.0,), (0.0,), (0.0,), (None,)])
    v = M.reference(z, "v")
    out = aggregate(z, {"k": v}, {"n": M.count()}, total_order=True).collect()
    assert sorted((str(r.k), r.n) for r in out) == [("-0.0", 1), ("0.0", 2), ("None", 1)]
    assert aggregate(z, {}, {"d": M.count(v, distinct=True, total_order=True), "e": M.count(v, distinct=True)}).first()[:] == (2, 1)
    low = aggregate(z, {}, {"lo": M.min_(v, total_order=True), "hi": M.max_(v, total_order=True)}).first()
    assert (str(low.lo), str(low.hi)) == ("-0.0", "0.0")


def test_three_valued_logic(spark, mode):
    t = [True, False, None]
    df = frame(spark, "a boolean, b boolean", [(x, y) for x in t for y in t])
    a, b = M.reference(df, "a"), M.reference(df, "b")
    assert run(df, M.all_of(a, b)) == [True, False, None, False, False, False, None, False, None]
    assert run(df, M.any_of(a, b)) == [True, True, True, True, False, None, True, None, None]
    assert run(df, M.not_(a)) == [False] * 3 + [True] * 3 + [None] * 3
    assert run(df, M.all_of()) == [True] * 9 and run(df, M.any_of()) == [False] * 9


def test_strict_logic_keeps_errors(spark):
    df = frame(spark, "a boolean, n bigint", [(False, 0)])
    bad = M.equal(M.divide(M.constant(1, T.INT64), M.reference(df, "n")), M.constant(1, T.INT64))
    a = M.reference(df, "a")
    fails(ErrorKind.DIVISION_BY_ZERO, lambda: run(df, M.strict(M.all_of(a, bad), a, bad)))


def test_case_and_coalesce_are_lazy(spark, mode):
    df = frame(spark, "x bigint, y bigint", [(0, 100), (2, 10), (None, 100), (-2, 6), (4, 0), (2, 10)])
    x, y, zero = M.reference(df, "x"), M.reference(df, "y"), M.constant(0, T.INT64)
    v = M.case([(M.equal(x, zero), zero), (M.is_null(x), zero)], M.divide(y, x))
    assert run(df, v) == [0, 5, 0, -3, 0, 5]
    assert run(df, M.case([], y)) == [100, 10, 100, 6, 0, 10]
    df = frame(spark, "v bigint, d bigint", [(7, 0), (None, 2), (9, 0), (None, 4)])
    assert run(df, M.coalesce(M.reference(df, "v"), M.divide(M.constant(100, T.INT64), M.reference(df, "d")))) == [7, 50, 9, 25]
    # a constant that would fail is not computed over no rows
    assert run(df.filter("false"), M.case([(M.is_null(M.reference(df, "v")), M.divide(M.constant(1, T.INT64), M.subtract(M.reference(df, "d"), M.reference(df, "d"))))], zero)) == []


def test_null_tests_and_null_type(spark, mode):
    df = frame(spark, "a bigint, b bigint", [(1, 1), (None, 1), (None, None), (2, 1)])
    a, b = M.reference(df, "a"), M.reference(df, "b")
    assert run(df, M.is_null(a)) == [False, True, True, False]
    assert run(df, M.is_not_distinct_from(a, b)) == [True, False, True, False]
    assert run(df, M.equal(M.null(), M.null())) == [None] * 4
    assert run(filter_rows(df, M.null(T.BOOLEAN)), a) == []
    fails(ErrorKind.INVALID_INPUT, lambda: run(df, M.assert_not_null(a)))
    one = M.equal(a, M.constant(1, T.INT64))
    fails(ErrorKind.ARITHMETIC_OVERFLOW, lambda: run(df, M.raise_if(one, ErrorKind.ARITHMETIC_OVERFLOW, b)))
    assert run(df, M.raise_if(M.all_of(one, M.not_(one)), ErrorKind.DIVISION_BY_ZERO, b)) == [1, 1, None, 1]
    fails(ErrorKind.UNSUPPORTED, lambda: M.raise_if(one, ErrorKind.INTERNAL, b))


def test_text_and_binary_order_by_bytes(spark):
    df = frame(spark, "a string, b binary", [("é", b"\x02"), ("z", b"\x01\x00"), ("Z", b"\xff"), (None, None)])
    assert run(df, M.less(M.reference(df, "a"), M.constant("z", T.UTF8))) == [False, False, True, None]
    r = aggregate(df, {}, {"a": M.max_(M.reference(df, "a")), "b": M.min_(M.reference(df, "b")), "c": M.max_(M.reference(df, "b"))}).first()
    assert (r.a, bytes(r.b), bytes(r.c)) == ("é", b"\x01\x00", b"\xff")


def test_plans_that_do_not_type(spark):
    df = frame(spark, "a bigint, b int, s string, t timestamp, l array<int>", [(1, 1, "x", None, [1])])
    a, b, s, t = (M.reference(df, c) for c in "abst")
    for f in (lambda: M.add(a, b), lambda: M.add(s, s), lambda: M.equal(a, s), lambda: M.all_of(a), lambda: M.case([(a, a)], a), lambda: M.case([(M.is_null(a), b)], a), lambda: M.coalesce(), lambda: M.reference(df, "zz"), lambda: filter_rows(df, s), lambda: custom([df], 2, None), lambda: M.Aggregate("sum", (), T.INT64)):
        fails(ErrorKind.INVALID_PLAN, f)
    for f in (lambda: M.cast(t, T.INT64), lambda: M.reference(df, "l"), lambda: M.sum_(t), lambda: M.sum_(a, T.INT32), lambda: M.Aggregate("sum", (a,), T.INT64, distinct=True)):
        fails(ErrorKind.UNSUPPORTED, f)


CASTS = [
    ("string", T.INT64, ["5", "-7", "+3", " 5", "5.0", "", "x", "9223372036854775808", None], [5, -7, 3, None, None, None, None, None, None]),
    ("string", T.UINT8, ["5", "+255", "-0", "256"], [5, 255, None, None]),
    ("string", T.FLOAT64, ["1", ".5", "5.", "1e3", "inf", "-Infinity", "NaN", "1d", "0x1p3", " 1", "", "."], [1.0, 0.5, 5.0, 1000.0, INF, -INF, NAN, None, None, None, None, None]),
    ("string", T.BOOLEAN, [" On ", "tr", "OF", "1", "0", "2", "maybe", None], [True, True, False, True, False, None, None, None]),
    ("double", T.INT8, [-128.5, 127.9, 128.0, -129.0, NAN, INF, None], [-128, 127, None, None, None, None, None]),
    ("double", T.INT64, [9223372036854775808.0, -9223372036854775808.0, 1.9, -1.9], [None, -(1 << 63), 1, -1]),
    ("float", T.INT32, [2147483648.0, -2147483648.0, 1.5], [None, -(1 << 31), 1]),
    ("double", T.UINT64, [1.8446744073709552e19, 9.3e18, -0.5, -1.0], [None, 9300000000000000000, 0, None]),
    ("double", T.BOOLEAN, [0.0, -0.0, 2.0, NAN, None], [False, False, True, True, None]),
    ("boolean", T.INT32, [True, False, None], [1, 0, None]),
    ("boolean", T.FLOAT64, [True, False], [1.0, 0.0]),
    ("bigint", T.INT8, [127, 128, -128, -129, None], [127, None, -128, None, None]),
    ("bigint", T.UINT32, [4294967295, 4294967296, -1], [4294967295, None, None]),
    ("double", T.UTF8, [1.0, 1e16, -0.0, NAN, INF, -INF, 0.1, 1e-7, None], ["1", "10000000000000000", "-0", "NaN", "inf", "-inf", "0.1", "0.0000001", None]),
    ("float", T.UTF8, [0.1, 16777216.0], ["0.1", "16777216"]),
    ("bigint", T.UTF8, [5, -5], ["5", "-5"]),
    ("boolean", T.UTF8, [True, False], ["true", "false"]),
    ("binary", T.UTF8, [b"ok", b"\xff", None], ["ok", None, None]),
    ("string", T.BINARY, ["é", None], ["é".encode(), None]),
]


@pytest.mark.parametrize("sql,to,given,want", CASTS, ids=[f"{s}-{t}-{i}" for i, (s, t, _, _) in enumerate(CASTS)])
def test_casts(spark, sql, to, given, want):
    df = frame(spark, f"a {sql}", [(g,) for g in given])
    a = M.reference(df, "a")
    got = run(df, M.try_cast(a, to))
    same([bytes(g) if isinstance(g, bytearray) else int(g) if isinstance(g, Decimal) else g for g in got], want)
    good = [k for k, (g, w) in enumerate(zip(given, want)) if g is None or w is not None]
    ok = df.filter(df.i.isin(good))
    assert len(run(ok, M.cast(M.reference(ok, "a"), to))) == len(good)
    if len(good) < len(given):
        fails(ErrorKind.INVALID_INPUT, lambda: run(df, M.cast(a, to)))


def test_null_and_equal_casts(spark):
    df = frame(spark, "a bigint", [(1,)])
    assert run(df, M.cast(M.null(), T.UTF8)) == [None]
    a = M.reference(df, "a")
    assert M.cast(a, T.INT64) is a


def test_sums(spark, mode):
    top = (1 << 63) - 1
    df = frame(spark, "g string, v bigint, s string, d double", [("a", top, "1", -0.0), ("a", 1, "x", 1.5), ("b", None, "x", None)])
    v, s, g = (M.reference(df, c) for c in "vsg")
    out = aggregate(df, {"g": g}, {"w": M.sum_(v), "t": M.sum_(s), "c": M.count(v), "a": M.avg(s)}).orderBy("g").collect()
    assert [tuple(r) for r in out] == [("a", -(1 << 63), 1, 2, 1.0), ("b", None, None, 0, None)]
    u = frame(spark, "v decimal(20,0)", [(Decimal((1 << 64) - 1),), (Decimal(1),)])
    assert int(aggregate(u, {}, {"s": M.sum_(M.reference(u, "v", T.UINT64), T.UINT64)}).first().s) == 0


def test_aggregates_over_nothing_and_one_row(spark):
    df = frame(spark, "x double, y double", [(1.0, 2.0)])
    x, y = M.reference(df, "x"), M.reference(df, "y")
    made = {"n": M.count(), "s": M.sum_(x), "a": M.avg(x), "lo": M.min_(x), "c": M.covar_pop(x, y)}
    assert aggregate(df, {}, made).first()[:] == (1, 1, 1.0, 1.0, 0.0)
    none = df.filter("x > 5")
    assert aggregate(none, {}, made).first()[:] == (0, None, None, None, None)
    assert aggregate(none, {"x": x}, made).count() == 0
    assert distinct(none, {"x": x}).count() == 0


def test_filter_keeps_groups_and_hides_errors(spark):
    df = frame(spark, "g int, v bigint", [(1, 0), (1, 5), (2, 0), (None, 1)])
    g, v = M.reference(df, "g"), M.reference(df, "v")
    some = M.not_equal(v, M.constant(0, T.INT64))
    out = aggregate(df, {"g": g}, {"s": M.sum_(M.divide(M.constant(100, T.INT64), v)).where(some), "n": M.count().where(some)})
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 20, 1), (2, None, 0), (None, 100, 1)]


def test_inputs_of_custom_operators(spark):
    df = spark.createDataFrame([(1,), (2,)], "v bigint")
    assert project(df, {}).count() == 2
    assert custom([df, df], 2, lambda a, b: a.union(b)).count() == 4


def test_plans_need_ansi_mode(spark):
    df = spark.createDataFrame([(1,)], "v bigint")
    v = M.reference(df, "v")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        for build in (lambda: M.add(v, v), lambda: M.divide(v, v), lambda: M.cast(v, T.INT8), lambda: M.sum_(v).column()):
            fails(ErrorKind.UNSUPPORTED, build)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    M.add(v, v)


def test_text_with_white_space_around(spark):
    df = spark.createDataFrame([("42\n", "1.5\n", "nan\n", "\ttrue\n"), ("42", "1.5", "nan", "\u2003OFF\u00a0")], "i string, f string, s string, b string")
    made = {"i": T.INT64, "f": T.FLOAT64, "s": T.FLOAT64, "b": T.BOOLEAN}
    first, second = project(df, {c: M.try_cast(M.reference(df, c), t) for c, t in made.items()}).collect()
    assert tuple(first) == (None, None, None, True)
    assert second.i == 42 and second.f == 1.5 and second.s != second.s and second.b is False
    for c in "ifs":
        fails(ErrorKind.INVALID_INPUT, lambda: project(df, {c: M.cast(M.reference(df, c), made[c])}).collect())  # noqa: B023


def test_unsigned_sums_of_many_parts(spark):
    top = (1 << 64) - 1
    df = spark.createDataFrame([(Decimal(x),) for x in (top, top, 1 << 63, 5)], "v decimal(20,0)")
    assert aggregate(df, {}, {"t": M.sum_(M.reference(df, "v", T.UINT64), T.UINT64)}).first().t == (2 * top + (1 << 63) + 5) % (1 << 64)
