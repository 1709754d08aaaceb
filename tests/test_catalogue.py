"""Every registered query of the relational part against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from millrace.plans.catalogue import ORACLE_SQL, QUERIES

from .compare import both, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    (cols, ours), (their_cols, theirs) = both(spark, QUERIES[name], ORACLE_SQL[name], sf)
    assert cols == their_cols
    assert len(ours) == len(theirs)
    assert ours == theirs


def _generates(plan):
    below = plan.children()
    found = [plan] if plan.nodeName() == "Generate" else []
    return found + [g for i in range(below.size()) for g in _generates(below.apply(i))]


def test_pieces_do_not_carry_their_text(spark, tmp_path):
    """Copied into each piece, texts would make the work grow with the square of their lengths."""
    texts = ["12", "+7 x\n8 9", "-0", "", " ", None, "5\n", "-9223372036854775808", "9223372036854775808", "9" * 5000, "7 word " * 20000]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, f"src{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(path)
    df = QUERIES["cast_text_int_try"](spark, str(tmp_path))
    (split,) = _generates(df._jdf.queryExecution().sparkPlan())
    carried = split.requiredChildOutput()
    assert sorted(carried.apply(i).name() for i in range(carried.size())) == ["a", "doc_id", "s"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    rel = con.sql(ORACLE_SQL["cast_text_int_try"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
