"""What plans of large tables must not do: move rows again, read what no route asks for, filter maps that are whole."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans.catalog import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cancelled_details_stay_where_their_order_lies(spark, sf, shuffled):
    details = plan(QUERIES["order_detail_wide"](spark, sf)).count("Exchange hashpartitioning")
    assert plan(QUERIES["order_cancel_detail"](spark, sf)).count("Exchange hashpartitioning") == details + 1


def test_records_without_a_route_are_not_made(spark, sf):
    frame = QUERIES["dim_filter"](spark, sf)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()") == 1


def test_maps_leave_nulls_out_and_whole_ones_are_not_filtered(spark):
    from tidemark.plans.envelopes import _map

    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").withColumn("m", _map(a=F.col("a"), b=F.col("b")))
    assert [r["m"] for r in rows.orderBy("a").collect()] == [{"a": "1", "b": "x"}, {"a": "2"}]
    assert "CASE WHEN" in rows._jdf.queryExecution().analyzed().toString()


def test_listed_columns_with_spaces(spark):
    from tidemark.operators.joins import only_columns

    rows = spark.sql("select map('a', '1', 'b', '2', 'c', '3') as m, 'a , c' as n union all select null, 'a'")
    assert sorted(str(r[0]) for r in rows.select(only_columns("m", "n")).collect()) == ["None", str({"a": "1", "c": "3"})]


def test_words_are_cut_without_a_lambda(spark):
    from tidemark.functions.scalars import words

    rows = spark.createDataFrame([(",, Über  x_1 — ",), ("",), (" ., ",), (None,)], "t string").select(words("t").alias("w"))
    assert [r["w"] for r in rows.collect()] == [["über", "x_1"], [], [], None]
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
