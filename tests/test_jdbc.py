"""Snapshots of a database, with the embedded one that comes with Spark."""

import pytest

from tidemark.sources.readers import camel_case, jdbc_snapshot, key_ranges


@pytest.fixture(scope="module")
def url(spark):
    url = "jdbc:derby:memory:shop;create=true"
    rows = spark.range(1000).selectExpr("cast(if(id % 100 = 99, null, id * id) as bigint) as ROW_ID", "concat('n', id) as SKU_NAME", "id as PLAIN")
    rows.write.jdbc(url, "orders", mode="overwrite")
    return url


def test_one_task_for_each_range_of_the_key(spark, url):
    query = "select row_id, sku_name, plain from orders where plain < 900"
    rows = jdbc_snapshot(spark, url, query, key="row_id", parts=5, camel=True)
    assert rows.columns == ["rowId", "skuName", "plain"]
    assert rows.rdd.getNumPartitions() == 5
    sizes = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 900 and max(sizes) < 220
    one = jdbc_snapshot(spark, url, query)
    assert sorted(map(str, rows.toDF("a", "b", "c").collect())) == sorted(map(str, one.toDF("a", "b", "c").collect()))
    assert jdbc_snapshot(spark, url, query + " and plain < 0", key="row_id").count() == 0


def test_ranges_and_names():
    assert key_ranges("k", [5, 1, 5]) == ["(k < 1 or k is null)", "k >= 1 and k < 5", "k >= 5"] and key_ranges("k", []) == ["1 = 1"]
    assert [camel_case(n) for n in ("CREATE_TIME", "create_time", "ID", "id", "skuName", "_a__b_", "__")] == ["createTime", "createTime", "id", "id", "skuName", "aB", ""]
