"""Registered queries over the star schema, each with DuckDB SQL for the same rows.

The tables hold no nulls, so queries about nulls make them with ``CASE`` alike
on both sides.  Floats are rounded where sums may differ in their last digits.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ErrorKind
from ..functions import (
    Expr, add, all_of, any_of, assert_not_null, avg, case, cast, coalesce, constant, count, covar_pop, divide, equal, greater, greater_or_equal, is_distinct_from,
    is_not_distinct_from, is_not_null, is_null, less, less_or_equal, max_, min_, multiply, negate, not_, not_equal, null, raise_if, reference, remainder, strict, subtract, sum_, try_cast,
)
from ..operators.relational import aggregate, distinct, filter_rows, project, scan
from ..sources.tasks import TaskSource
from ..types import BINARY, BOOLEAN, FLOAT32, FLOAT64, INT8, INT16, INT32, INT64, UINT8, UINT32, UINT64, UTF8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register the function under its name, with its SQL."""

    def add_to(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add_to


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return scan(spark, f"{sf}/{name}.parquet", columns or None)


def _i64(v: int) -> Expr:
    return constant(v, INT64)


def _f64(v: float) -> Expr:
    return constant(v, FLOAT64)


def _long(df: DataFrame, name: str) -> Expr:
    return cast(reference(df, name), INT64)


def _nulled(e: Expr, value: Expr) -> Expr:
    """``e``, but null where it equals ``value``."""
    return case([(equal(e, value), null(e.type))], e)


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""
SELECT l_returnflag, l_linestatus, cast(sum(l_orderkey + 1) AS bigint) AS total, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_supp,
  round(avg(l_quantity), 4) AS avg_qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_price, round(covar_pop(l_quantity, l_extendedprice), 4) AS covar
FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 30 GROUP BY l_returnflag, l_linestatus""")
def flagship(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    r = lambda c: reference(df, c)
    df = filter_rows(df, all_of(greater(r("l_discount"), _f64(0.05)), less(r("l_quantity"), _f64(30.0))))
    keys = {c: r(c) for c in ("l_returnflag", "l_linestatus")}
    out = aggregate(df, keys, {
        "total": sum_(add(_long(df, "l_orderkey"), _i64(1))), "n_rows": count(), "n_supp": count(r("l_suppkey"), distinct=True), "avg_qty": avg(r("l_quantity")),
        "first_ship": min_(r("l_shipdate")), "max_price": max_(r("l_extendedprice")), "covar": covar_pop(r("l_quantity"), r("l_extendedprice")),
    })
    return _rounded(out, "avg_qty", "covar")


# scan, filter, project


@query("SELECT * FROM supplier")
def scan_all(spark, sf):
    return _table(spark, sf, "supplier")


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def scan_projection(spark, sf):
    return _table(spark, sf, "orders", "o_orderstatus", "o_orderkey")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def filter_simple(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_quantity")
    return filter_rows(df, greater_or_equal(reference(df, "l_quantity"), _f64(45.0)))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_linenumber, 3) > 2")
def filter_null_predicate(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return filter_rows(df, greater(_nulled(_long(df, "l_linenumber"), _i64(3)), _i64(2)))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_stacked(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    df = filter_rows(df, greater(reference(df, "o_totalprice"), _f64(100000.0)), ["o_orderkey", "o_orderstatus"])
    return filter_rows(df, equal(reference(df, "o_orderstatus"), constant("F", UTF8)), ["o_orderkey"])


@query("SELECT l_orderkey + l_linenumber AS a, l_orderkey - l_linenumber AS s, l_orderkey * l_linenumber AS m, l_quantity * l_extendedprice AS f FROM lineitem")
def project_add_sub_mul(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    a, b = _long(df, "l_orderkey"), _long(df, "l_linenumber")
    return project(df, {"a": add(a, b), "s": subtract(a, b), "m": multiply(a, b), "f": multiply(reference(df, "l_quantity"), reference(df, "l_extendedprice"))})


@query("SELECT o_orderkey, -o_orderkey AS n, -o_totalprice AS f FROM orders")
def project_negate(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "n": negate(_long(df, "o_orderkey")), "f": negate(reference(df, "o_totalprice"))})


@query("SELECT o_orderkey, cast(7 AS bigint) AS i, 0.5::double AS f, true AS b, 'x' AS t, cast(NULL AS bigint) AS z FROM orders")
def project_constant(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "i": _i64(7), "f": _f64(0.5), "b": constant(True, BOOLEAN), "t": constant("x", UTF8), "z": null(INT64)})


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
def project_nothing(spark, sf):
    df = _table(spark, sf, "lineitem", "l_quantity")
    return aggregate(project(filter_rows(df, less(reference(df, "l_quantity"), _f64(10.0))), {}), {}, {"n": count()})


# arithmetic and comparison


@query("SELECT l_orderkey, l_orderkey // l_linenumber AS q, (0 - l_orderkey) // (l_linenumber + 1) AS neg FROM lineitem")
def int_divide(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    a, b = _long(df, "l_orderkey"), _long(df, "l_linenumber")
    return project(df, {"l_orderkey": a, "q": divide(a, b), "neg": divide(subtract(_i64(0), a), add(b, _i64(1)))})


@query("SELECT l_orderkey, l_orderkey % l_linenumber AS r, (0 - l_orderkey) % (l_linenumber + 1) AS neg FROM lineitem")
def int_remainder(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    a, b = _long(df, "l_orderkey"), _long(df, "l_linenumber")
    return project(df, {"l_orderkey": a, "r": remainder(a, b), "neg": remainder(subtract(_i64(0), a), add(b, _i64(1)))})


@query("SELECT l_orderkey, l_linenumber, isinf(q) AS inf, isnan(q) AS nan, CASE WHEN NOT isinf(q) AND NOT isnan(q) THEN q END AS q FROM (SELECT *, (l_quantity - 25) / (l_discount * 100 - 5) AS q FROM lineitem)")
def float_divide_ieee(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    q = divide(subtract(reference(df, "l_quantity"), _f64(25.0)), subtract(multiply(reference(df, "l_discount"), _f64(100.0)), _f64(5.0)))
    df = df.select("l_orderkey", "l_linenumber", q.column.alias("q"))
    inf = F.abs("q") == float("inf")
    return df.select("l_orderkey", "l_linenumber", inf.alias("inf"), F.isnan("q").alias("nan"), F.when(~inf & ~F.isnan("q"), F.col("q")).alias("q"))


@query("SELECT l_orderkey, l_linenumber, isnan(r) AS nan, CASE WHEN NOT isnan(r) THEN r END AS r FROM (SELECT *, l_quantity % (l_linenumber::double - 3) AS r FROM lineitem)")
def float_remainder_ieee(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    r = remainder(reference(df, "l_quantity"), subtract(cast(reference(df, "l_linenumber"), FLOAT64), _f64(3.0))).column
    return df.select("l_orderkey", "l_linenumber", F.isnan(r).alias("nan"), F.when(~F.isnan(r), r).alias("r"))


@query("SELECT l_orderkey, l_linenumber, l_partkey = l_suppkey AS eq, l_partkey <> l_suppkey AS ne, l_partkey < l_suppkey AS lt, l_partkey <= l_suppkey AS le, l_partkey > l_suppkey AS gt, l_partkey >= l_suppkey AS ge FROM lineitem")
def compare_all(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a, b = _long(df, "l_partkey"), _long(df, "l_suppkey")
    made = {"eq": equal, "ne": not_equal, "lt": less, "le": less_or_equal, "gt": greater, "ge": greater_or_equal}
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber")} | {n: f(a, b) for n, f in made.items()})


@query("SELECT o_orderkey, o_orderstatus < 'O' AS lt, o_orderstatus >= 'F' AS ge, o_orderstatus = 'P' AS eq FROM orders")
def compare_text(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    s = reference(df, "o_orderstatus")
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "lt": less(s, constant("O", UTF8)), "ge": greater_or_equal(s, constant("F", UTF8)), "eq": equal(s, constant("P", UTF8))})


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS third, (o_orderkey % 3 = 0) > (o_totalprice > 150000) AS gt, (o_orderkey % 3 = 0) = (o_totalprice > 150000) AS eq FROM orders")
def compare_boolean(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    third, dear = equal(remainder(_long(df, "o_orderkey"), _i64(3)), _i64(0)), greater(reference(df, "o_totalprice"), _f64(150000.0))
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "third": third, "gt": greater(third, dear), "eq": equal(third, dear)})


@query("SELECT l_orderkey, l_linenumber, l_shipdate < (SELECT max(l_shipdate) FROM lineitem) AS lt FROM lineitem WHERE l_shipdate > (SELECT min(l_shipdate) FROM lineitem)")
def compare_timestamp(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    ends = aggregate(df, {}, {"a": min_(reference(df, "l_shipdate")), "b": max_(reference(df, "l_shipdate"))})
    both = df.join(F.broadcast(ends))  # one row
    both = filter_rows(both, greater(reference(both, "l_shipdate"), reference(both, "a")))
    return project(both, {"l_orderkey": reference(both, "l_orderkey"), "l_linenumber": reference(both, "l_linenumber"), "lt": less(reference(both, "l_shipdate"), reference(both, "b"))})


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderstatus, 'O') AS same, nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(o_orderstatus, 'O') AS other FROM orders")
def null_safe(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    s = reference(df, "o_orderstatus")
    a, b = _nulled(s, constant("F", UTF8)), _nulled(s, constant("O", UTF8))
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "same": is_not_distinct_from(a, b), "other": is_distinct_from(a, b)})


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS is_null, nullif(o_orderstatus, 'F') IS NOT NULL AS is_not_null FROM orders")
def null_tests(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    a = _nulled(reference(df, "o_orderstatus"), constant("F", UTF8))
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "is_null": is_null(a), "is_not_null": is_not_null(a)})


@query("SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 1) + l_orderkey AS a, nullif(l_linenumber, 1) // 0 AS z FROM lineitem WHERE nullif(l_linenumber, 1) IS NULL")
def null_arithmetic(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    n = _nulled(_long(df, "l_linenumber"), _i64(1))
    df = filter_rows(df, is_null(n))
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "a": add(n, _long(df, "l_orderkey")), "z": divide(n, subtract(n, n))})


# logic, case, coalesce


@query("SELECT l_orderkey, l_linenumber, (nullif(l_linenumber, 1) > 2) AND (l_discount > 0.05) AS a, (nullif(l_linenumber, 1) > 2) OR (l_discount > 0.05) AS o, NOT (nullif(l_linenumber, 1) > 2) AS n FROM lineitem")
def logic_kleene(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    p, q = greater(_nulled(_long(df, "l_linenumber"), _i64(1)), _i64(2)), greater(reference(df, "l_discount"), _f64(0.05))
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "a": all_of(p, q), "o": any_of(p, q), "n": not_(p)})


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN 100 // (l_linenumber - 3) ELSE 0 END AS v FROM lineitem")
def case_guarded_division(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    n = _long(df, "l_linenumber")
    v = case([(not_equal(n, _i64(3)), divide(_i64(100), subtract(n, _i64(3))))], _i64(0))
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "v": v})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE CASE WHEN o_orderstatus = 'F' THEN 'low-f' ELSE 'low' END END AS band FROM orders")
def case_nested(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    p, t = reference(df, "o_totalprice"), lambda s: constant(s, UTF8)
    low = case([(equal(reference(df, "o_orderstatus"), t("F")), t("low-f"))], t("low"))
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "band": case([(greater(p, _f64(200000.0)), t("high")), (greater(p, _f64(100000.0)), t("mid"))], low)})


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_linenumber, 2), l_partkey // CASE WHEN l_linenumber = 2 THEN 7 ELSE 0 END) AS v FROM lineitem")
def coalesce_lazy(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    n = _long(df, "l_linenumber")
    by = case([(equal(n, _i64(2)), _i64(7))], _i64(0))
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "v": coalesce(_nulled(n, _i64(2)), divide(_long(df, "l_partkey"), by))})


# casts


@query("SELECT o_orderkey, cast(try_cast(o_orderkey AS tinyint) AS int) AS i8, cast(try_cast(o_orderkey * 7 AS smallint) AS int) AS i16, try_cast(o_orderkey * 100000 AS int) AS i32, cast(try_cast(o_orderkey AS utinyint) AS int) AS u8, cast(try_cast(o_orderkey * 1000000 AS uinteger) AS bigint) AS u32 FROM orders")
def cast_int_narrow_try(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    k = _long(df, "o_orderkey")
    x = lambda by, to, then: cast(try_cast(multiply(k, _i64(by)), to), then)
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "i8": x(1, INT8, INT32), "i16": x(7, INT16, INT32), "i32": x(100000, INT32, INT32), "u8": x(1, UINT8, INT32), "u32": x(1000000, UINT32, INT64)})


@query(
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text || ' 12' || chr(10) || ' +7 -0 99999999999999999999', ' ')) AS t FROM documents)
    SELECT doc_id, count(*) AS n, count(v) AS numbers, cast(sum(v) AS bigint) AS total, max(s) AS s, max(a) AS a FROM (
      SELECT doc_id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN try_cast(t AS bigint) END AS v FROM w)
    JOIN (SELECT doc_id, CASE WHEN regexp_full_match(source, 'src[0-9]+') THEN cast(substr(source, 4) AS bigint) END AS s, CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN try_cast(text AS bigint) END AS a FROM documents) USING (doc_id) GROUP BY doc_id"""
)
def cast_text_int_try(spark, sf):
    """Whole texts, and every piece of them between spaces, line breaks included.

    Texts are cast before they are split, so that no piece carries its text along.
    """
    df = _table(spark, sf, "documents", "doc_id", "text", "source").withColumn("s", F.expr("substr(source, 4)"))
    df = project(df, {c: reference(df, c) for c in ("doc_id", "text")} | {to: try_cast(reference(df, c), INT64) for to, c in (("s", "s"), ("a", "text"))})
    t = F.split(F.concat("text", F.lit(" 12\n +7 -0 99999999999999999999")), " ")
    df = df.select("doc_id", "s", "a", F.explode(t).alias("t"))
    df = project(df, {c: reference(df, c) for c in ("doc_id", "s", "a")} | {"v": try_cast(reference(df, "t"), INT64)})
    made = {"n": count(), "numbers": count(reference(df, "v")), "total": sum_(reference(df, "v")), "s": max_(reference(df, "s")), "a": max_(reference(df, "a"))}
    return aggregate(df, {"doc_id": reference(df, "doc_id")}, made)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 4.5 END AS f, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::double END AS special, CASE o_orderkey % 4 WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS b, CASE o_orderkey % 4 WHEN 1 THEN 7 END AS i FROM orders")
def cast_text_line_breaks(spark, sf):
    """Numbers take no white space around them, a last line break neither; booleans take any."""
    df = _table(spark, sf, "orders", "o_orderkey")
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    df = df.select("o_orderkey", pick("4.5", "4.5\n", " 4.5", "4.5\u00a0").alias("f"), pick("nan\n", "nan", "inf\n", "").alias("special"), pick("\ttrue\n", "\u00a0Yes\u2003", "\u30001\r\n", " OFF\x0b").alias("b"), pick("7\n", "7", "\n7", "7 ").alias("i"))
    made = {"f": FLOAT64, "special": FLOAT64, "b": BOOLEAN, "i": INT64}
    return project(df, {"o_orderkey": reference(df, "o_orderkey")} | {c: try_cast(reference(df, c), to) for c, to in made.items()})


@query("SELECT o_orderkey, cast(cast(o_orderkey AS varchar) || '.5e1' AS double) AS a, cast(NULL AS double) AS b, cast('.' || cast(o_orderkey AS varchar) AS double) AS c FROM orders")
def cast_text_float_try(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    df = df.select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".5e1")).alias("a"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("b"), F.concat(F.lit("."), F.col("o_orderkey").cast("string")).alias("c"))
    return project(df, {"o_orderkey": reference(df, "o_orderkey")} | {c: try_cast(reference(df, c), FLOAT64) for c in "abc"})


@query("SELECT l_orderkey, l_linenumber, cast(try_cast(trunc(l_quantity * 10) AS tinyint) AS int) AS i8, try_cast(trunc(l_extendedprice) AS bigint) AS i64 FROM lineitem")
def cast_float_int(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "i8": cast(try_cast(multiply(reference(df, "l_quantity"), _f64(10.0)), INT8), INT32), "i64": cast(reference(df, "l_extendedprice"), INT64)})


@query("SELECT l_orderkey, l_linenumber, l_linenumber - 3 <> 0 AS b, cast(l_linenumber > 3 AS int) AS i, cast(l_linenumber > 3 AS double) AS f, l_discount <> 0 AS d FROM lineitem")
def cast_bool(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    n = _long(df, "l_linenumber")
    big = greater(n, _i64(3))
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "b": cast(subtract(n, _i64(3)), BOOLEAN), "i": cast(big, INT32), "f": cast(big, FLOAT64), "d": cast(reference(df, "l_discount"), BOOLEAN)})


@query("SELECT doc_id, CASE WHEN lower(lang) IN ('f', 'fa', 'fal', 'fals', 'false', 'n', 'no', 'of', 'off', '0') THEN false WHEN lower(lang) IN ('t', 'tr', 'tru', 'true', 'y', 'ye', 'yes', 'on', '1') THEN true END AS plain, CASE lang WHEN 'en' THEN true WHEN 'fr' THEN false WHEN 'de' THEN true END AS made FROM documents")
def cast_text_bool_try(spark, sf):
    df = _table(spark, sf, "documents", "doc_id", "lang")
    lang = reference(df, "lang")
    t = lambda s: constant(s, UTF8)
    made = case([(equal(lang, t("en")), t(" On ")), (equal(lang, t("fr")), t("OFF")), (equal(lang, t("de")), t("tr"))], t("maybe"))
    return project(df, {"doc_id": reference(df, "doc_id"), "plain": try_cast(lang, BOOLEAN), "made": try_cast(made, BOOLEAN)})


@query("SELECT o_orderkey, cast(o_orderkey AS varchar) AS i, cast(o_orderkey % 2 = 0 AS varchar) AS b FROM orders")
def cast_int_text(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    k = _long(df, "o_orderkey")
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "i": cast(k, UTF8), "b": cast(equal(remainder(k, _i64(2)), _i64(0)), UTF8)})


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = trunc(l_quantity) THEN cast(cast(l_quantity AS bigint) AS varchar) ELSE cast(l_quantity AS varchar) END AS t FROM lineitem")
def cast_float_text(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return project(df, {"l_orderkey": reference(df, "l_orderkey"), "l_linenumber": reference(df, "l_linenumber"), "t": cast(reference(df, "l_quantity"), UTF8)})


@query("SELECT doc_id, lang AS back FROM documents")
def cast_binary_text(spark, sf):
    df = _table(spark, sf, "documents", "doc_id", "lang")
    return project(df, {"doc_id": reference(df, "doc_id"), "back": try_cast(cast(reference(df, "lang"), BINARY), UTF8)})


@query("SELECT o_orderkey, cast(cast(o_totalprice AS float) AS double) AS f FROM orders")
def cast_float_narrow(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "f": cast(cast(reference(df, "o_totalprice"), FLOAT32), FLOAT64)})


@query("SELECT o_orderkey, cast(o_orderkey AS bigint) + 4000000000 AS s FROM orders WHERE o_orderkey < 294967296")
def unsigned_add(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    k = cast(_long(df, "o_orderkey"), UINT32)
    return project(df, {"o_orderkey": reference(df, "o_orderkey"), "s": cast(add(k, constant(4_000_000_000, UINT32)), INT64)})


# aggregates


@query("SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS m, cast(sum(l_orderkey) AS bigint) AS s, round(sum(l_extendedprice), 2) AS f, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_global(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    r = lambda c: reference(df, c)
    out = aggregate(df, {}, {"n": count(), "m": count(_nulled(_long(df, "l_linenumber"), _i64(1))), "s": sum_(r("l_orderkey")), "f": sum_(r("l_extendedprice"), FLOAT64), "a": avg(r("l_quantity")), "lo": min_(r("l_shipdate")), "hi": max_(r("l_shipdate"))})
    return out.withColumns({"f": F.round("f", 2), "a": F.round("a", 6)})


@query("SELECT o_custkey, cast(sum(o_orderkey) AS bigint) AS s, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY o_custkey")
def agg_grouped(spark, sf):
    df = _table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return aggregate(df, {"o_custkey": reference(df, "o_custkey")}, {"s": sum_(reference(df, "o_orderkey")), "n": count(), "m": max_(reference(df, "o_totalprice"))})


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_multi_key(spark, sf):
    df = _table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber")
    return aggregate(df, {c: reference(df, c) for c in df.columns}, {"n": count()})


@query("SELECT o_orderkey % 10 AS k, count(*) AS n, cast(sum(o_custkey) AS bigint) AS s FROM orders GROUP BY 1")
def agg_expr_key(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_custkey")
    return aggregate(df, {"k": remainder(_long(df, "o_orderkey"), _i64(10))}, {"n": count(), "s": sum_(reference(df, "o_custkey"))})


@query("SELECT 'all' AS category, cast(sum(o_orderkey + 2) AS bigint) AS total, count(*) AS n FROM orders WHERE o_orderkey > 100")
def agg_constant_key(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    k = _long(df, "o_orderkey")
    return aggregate(filter_rows(df, greater(k, _i64(100))), {"category": constant("all", UTF8)}, {"total": sum_(add(k, _i64(2))), "n": count()})


@query("SELECT nullif(l_linenumber, 3) AS k, count(*) AS n, count(nullif(l_suppkey, 5)) AS m, count(DISTINCT nullif(l_suppkey, 5)) AS d FROM lineitem GROUP BY 1")
def agg_null_key(spark, sf):
    df = _table(spark, sf, "lineitem", "l_linenumber", "l_suppkey")
    s = _nulled(_long(df, "l_suppkey"), _i64(5))
    return aggregate(df, {"k": _nulled(_long(df, "l_linenumber"), _i64(3))}, {"n": count(), "m": count(s), "d": count(s, distinct=True)})


@query("SELECT DISTINCT l_returnflag, nullif(l_linestatus, 'O') AS st FROM lineitem")
def distinct_keys(spark, sf):
    df = _table(spark, sf, "lineitem", "l_returnflag", "l_linestatus")
    return distinct(df, {"l_returnflag": reference(df, "l_returnflag"), "st": _nulled(reference(df, "l_linestatus"), constant("O", UTF8))})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_shipdate) AS d FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, sf):
    df = _table(spark, sf, "lineitem", "l_returnflag", "l_suppkey", "l_shipdate")
    return aggregate(df, {"l_returnflag": reference(df, "l_returnflag")}, {"s": count(reference(df, "l_suppkey"), distinct=True), "d": count(reference(df, "l_shipdate"), distinct=True)})


@query("SELECT l_linenumber, round(covar_pop(l_quantity, l_extendedprice), 4) AS c, round(covar_pop(l_discount, nullif(l_quantity, 10)), 8) AS d FROM lineitem GROUP BY 1")
def agg_covar_pop(spark, sf):
    df = _table(spark, sf, "lineitem", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    q = reference(df, "l_quantity")
    out = aggregate(df, {"l_linenumber": reference(df, "l_linenumber")}, {"c": covar_pop(q, reference(df, "l_extendedprice")), "d": covar_pop(reference(df, "l_discount"), _nulled(q, _f64(10.0)))})
    return out.withColumns({"c": F.round("c", 4), "d": F.round("d", 8)})


@query("SELECT o_orderstatus, round(avg(o_orderkey), 6) AS a, round(avg(CASE WHEN o_custkey > 10 THEN o_custkey END), 6) AS b FROM orders GROUP BY 1")
def agg_avg_int(spark, sf):
    df = _table(spark, sf, "orders", "o_orderstatus", "o_orderkey", "o_custkey")
    c = _long(df, "o_custkey")
    out = aggregate(df, {"o_orderstatus": reference(df, "o_orderstatus")}, {"a": avg(reference(df, "o_orderkey")), "b": avg(case([(greater(c, _i64(10)), c)], null(INT64)))})
    return _rounded(out, "a", "b", digits=6)


@query("SELECT l_returnflag, cast(sum(l_orderkey) FILTER (WHERE l_discount > 0.05) AS bigint) AS s, count(*) FILTER (WHERE l_quantity > 100) AS c, max(l_tax) FILTER (WHERE l_quantity < 5) AS m FROM lineitem GROUP BY 1")
def agg_filter(spark, sf):
    df = _table(spark, sf, "lineitem", "l_returnflag", "l_orderkey", "l_discount", "l_quantity", "l_tax")
    r = lambda c: reference(df, c)
    return aggregate(df, {"l_returnflag": r("l_returnflag")}, {"s": sum_(r("l_orderkey")).where(greater(r("l_discount"), _f64(0.05))), "c": count().where(greater(r("l_quantity"), _f64(100.0))), "m": max_(r("l_tax")).where(less(r("l_quantity"), _f64(5.0)))})


@query("SELECT cast(sum(CASE WHEN l_linenumber <> 3 THEN 100 // (l_linenumber - 3) END) AS bigint) AS s FROM lineitem")
def agg_filter_guards_error(spark, sf):
    df = _table(spark, sf, "lineitem", "l_linenumber")
    n = _long(df, "l_linenumber")
    return aggregate(df, {}, {"s": sum_(divide(_i64(100), subtract(n, _i64(3)))).where(not_equal(n, _i64(3)))})


@query("SELECT l_returnflag, cast(((sum(cast(l_orderkey * 400000000000 AS hugeint)) + 9223372036854775808::hugeint) % 18446744073709551616::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint - 9223372036854775808::hugeint AS bigint) AS s FROM lineitem GROUP BY 1")
def agg_sum_wrapping(spark, sf):
    df = _table(spark, sf, "lineitem", "l_returnflag", "l_orderkey")
    return aggregate(df, {"l_returnflag": reference(df, "l_returnflag")}, {"s": sum_(multiply(_long(df, "l_orderkey"), _i64(400_000_000_000)))})


@query("SELECT lang, cast(sum(cast(substr(source, 4) AS bigint)) AS bigint) AS s, cast(NULL AS bigint) AS none FROM documents GROUP BY 1")
def agg_sum_text_try(spark, sf):
    df = _table(spark, sf, "documents", "lang", "source").select("lang", "source", F.expr("substr(source, 4)").alias("t"))
    return aggregate(df, {"lang": reference(df, "lang")}, {"s": sum_(reference(df, "t")), "none": sum_(reference(df, "source"))})


@query("SELECT cast(sum(o_orderkey) AS varchar) AS s FROM orders")
def agg_sum_unsigned(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey")
    out = aggregate(df, {}, {"s": sum_(cast(_long(df, "o_orderkey"), UINT64), UINT64)})
    return out.select(F.col("s").cast("string").alias("s"))


@query("SELECT min(o_orderstatus) AS t, max(o_orderdate) AS d, min(o_totalprice) AS f, min(o_totalprice > 1000) AS b, max(o_orderstatus) AS u FROM orders")
def agg_minmax_types(spark, sf):
    df = _table(spark, sf, "orders", "o_orderstatus", "o_orderdate", "o_totalprice")
    r = lambda c: reference(df, c)
    return aggregate(df, {}, {"t": min_(r("o_orderstatus")), "d": max_(r("o_orderdate")), "f": min_(r("o_totalprice")), "b": min_(greater(r("o_totalprice"), _f64(1000.0))), "u": max_(r("o_orderstatus"))})


@query("SELECT count(*) AS c, cast(sum(o_orderkey) AS bigint) AS s, avg(o_totalprice) AS a, covar_pop(o_totalprice, o_totalprice) AS v FROM orders WHERE o_orderkey < 0")
def agg_empty_global(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    p = reference(df, "o_totalprice")
    df = filter_rows(df, less(_long(df, "o_orderkey"), _i64(0)))
    return aggregate(df, {}, {"c": count(), "s": sum_(reference(df, "o_orderkey")), "a": avg(p), "v": covar_pop(p, p)})


@query("SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderkey < 0 GROUP BY 1")
def agg_empty_grouped(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_custkey")
    return aggregate(filter_rows(df, less(_long(df, "o_orderkey"), _i64(0))), {"o_custkey": reference(df, "o_custkey")}, {"c": count()})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5")
def having(spark, sf):
    df = _table(spark, sf, "orders", "o_custkey")
    return aggregate(df, {"o_custkey": reference(df, "o_custkey")}, {"n": count()}, having=lambda out: greater(reference(out, "n"), _i64(5)).column)


@query("SELECT n, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5) GROUP BY n")
def two_level_agg(spark, sf):
    inner = having(spark, sf)
    return aggregate(inner, {"n": reference(inner, "n")}, {"c": count()})


@query("SELECT 'a' AS side, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def exchange_fanout(spark, sf):
    df = _table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    of = lambda s: filter_rows(df, equal(reference(df, "o_orderstatus"), constant(s, UTF8)), ["o_orderkey"])
    first, second = of("F"), of("O")
    sides = [aggregate(rows, {"side": constant(name, UTF8)}, {"n": count()}) for rows, name in ((first, "a"), (first.union(second), "b"))]
    return sides[0].union(sides[1])


# the four workloads of the published comparison


@query("SELECT event_id, user_id, value, ts FROM events")
def bench_scan(spark, sf):
    return _table(spark, sf, "events", "event_id", "user_id", "value", "ts")


@query("SELECT l_orderkey + 1 AS adjusted FROM lineitem WHERE l_quantity > 25")
def bench_filter_project(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_quantity")
    return project(filter_rows(df, greater(reference(df, "l_quantity"), _f64(25.0))), {"adjusted": add(_long(df, "l_orderkey"), _i64(1))})


@query("SELECT cast(sum(l_orderkey) AS bigint) AS total, count(l_orderkey) AS n FROM lineitem")
def bench_global_aggregate(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey")
    return aggregate(df, {}, {"total": sum_(reference(df, "l_orderkey")), "n": count(reference(df, "l_orderkey"))})


@query("SELECT l_suppkey, cast(sum(l_orderkey) AS bigint) AS total, count(l_orderkey) AS n FROM lineitem GROUP BY 1")
def bench_grouped_aggregate(spark, sf):
    df = _table(spark, sf, "lineitem", "l_suppkey", "l_orderkey")
    return aggregate(df, {"l_suppkey": reference(df, "l_suppkey")}, {"total": sum_(reference(df, "l_orderkey")), "n": count(reference(df, "l_orderkey"))})


# order of floats, arguments that are always computed, errors of rows, and the source of tasks


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false ELSE l_discount < 0 END AS lt, CASE l_linenumber WHEN 1 THEN false WHEN 2 THEN true ELSE l_discount = 0 END AS eq, CASE l_linenumber WHEN 1 THEN false ELSE true END AS ge, l_linenumber IN (1, 2) OR l_discount = 0 AS plain_eq, CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false ELSE l_discount <> 0 END AS differs FROM lineitem")
def compare_total_order(spark, sf):
    """-0.0 comes before 0.0 in the total order and equals it otherwise."""
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    n, zero = _long(df, "l_linenumber"), _f64(0.0)
    x = case([(equal(n, _i64(1)), _f64(-0.0)), (equal(n, _i64(2)), zero)], reference(df, "l_discount"))
    made = {"lt": less(x, zero, total_order=True), "eq": equal(x, zero, total_order=True), "ge": greater_or_equal(x, zero, total_order=True), "plain_eq": equal(x, zero), "differs": is_distinct_from(x, zero, total_order=True)}
    return project(df, {c: reference(df, c) for c in ("l_orderkey", "l_linenumber")} | made)


@query("SELECT CASE WHEN l_linenumber = 1 THEN '-0' WHEN l_linenumber = 2 THEN '0' ELSE 'other' END AS sign, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1")
def agg_total_order_keys(spark, sf):
    df = _table(spark, sf, "lineitem", "l_linenumber")
    df = filter_rows(df, less(_long(df, "l_linenumber"), _i64(4)))
    n = _long(df, "l_linenumber")
    x = case([(equal(n, _i64(1)), _f64(-0.0)), (equal(n, _i64(2)), _f64(0.0))], _f64(1.0))
    out = aggregate(df, {"x": x}, {"n": count()}, total_order=True)
    x = reference(out, "x")
    t = lambda s: constant(s, UTF8)
    sign = case([(equal(x, _f64(-0.0), total_order=True), t("-0")), (equal(x, _f64(0.0), total_order=True), t("0"))], t("other"))
    return project(out, {"sign": sign, "n": reference(out, "n")})


@query("SELECT l_orderkey, l_linenumber, l_linenumber > 3 AND 100 // l_linenumber > 20 AS both, l_linenumber > 3 OR 100 // l_linenumber > 20 AS either FROM lineitem")
def logic_strict(spark, sf):
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    n = _long(df, "l_linenumber")
    args = greater(n, _i64(3)), greater(divide(_i64(100), n), _i64(20))
    return project(df, {c: reference(df, c) for c in ("l_orderkey", "l_linenumber")} | {"both": strict(all_of(*args), *args), "either": strict(any_of(*args), *args)})


@query("SELECT l_orderkey, l_linenumber, l_quantity AS checked, l_tax AS there FROM lineitem")
def raise_if_never(spark, sf):
    """Rows that break a rule would fail the query; none does."""
    df = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    q = reference(df, "l_quantity")
    checked = raise_if(less(q, _f64(0.0)), ErrorKind.INVALID_INPUT, q)
    return project(df, {c: reference(df, c) for c in ("l_orderkey", "l_linenumber")} | {"checked": checked, "there": assert_not_null(reference(df, "l_tax"))})


@query("SELECT o_orderstatus, count(*) AS n, cast(sum(o_custkey) AS bigint) AS total FROM orders GROUP BY 1")
def task_source(spark, sf):
    """Row groups as tasks of a described source, one partition each."""
    path = f"{sf}/orders.parquet"
    files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
    tasks = [{"path": f, "row_groups": [k]} for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    spark.dataSource.register(TaskSource)
    source = spark.read.format("tasks").option("reader", "millrace.sources.tasks:parquet_task").option("tasks", json.dumps(tasks))
    df = source.schema("o_custkey bigint, o_orderstatus string").load()
    return aggregate(df, {"o_orderstatus": reference(df, "o_orderstatus")}, {"n": count(), "total": sum_(reference(df, "o_custkey"))})
