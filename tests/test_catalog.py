"""Every batch query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter
from datetime import datetime

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(frame.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall()) and got


def test_entry_is_whole(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["stt", "edt", "cur_date", "order_unique_user_count", "order_new_user_count"]


def test_library_stands_without_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(QUERIES)
