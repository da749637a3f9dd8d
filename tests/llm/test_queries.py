"""Queries that SQL can express against DuckDB, and what __spark_entry__ registers."""

from collections import Counter

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    frame, want = QUERIES[name](spark, sf), con.sql(ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
