"""Operators on rows written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F


def test_parsing_and_dirty_lines(spark):
    from tidemark.operators import logs

    good = '{"common":{"mid":"m1","uid":"u","is_new":"1"},"page":{"page_id":"home","during_time":5},"displays":[{"item":"1","item_type":"sku","pos_id":2,"pos_seq":1}],"actions":[{"action_id":"a","item":"1","ts":7}],"ts":1700000000000}'
    lines = spark.createDataFrame([(x,) for x in (good, '{"common":', "[1]", "text", '{"start":{"entry":"icon"},"common":{"mid":"m2"},"ts":1}')], "value string")
    log, dirty = logs.parsed(lines)
    assert sorted(r["raw"] for r in dirty.collect()) == ["[1]", "text", '{"common":']
    parts = logs.split(log)
    assert [(r["mid"], r["page_id"], r["ts"]) for r in parts["page"].collect()] == [("m1", "home", 1_700_000_000_000)]
    assert [(r["mid"], r["pos_id"], r["ts"]) for r in parts["display"].collect()] == [("m1", 2, 1_700_000_000_000)]
    assert "ts" in parts["action"].columns and [r["ts"] for r in parts["action"].collect()] == [7]
    assert [(r["mid"], r["start"]) for r in parts["start"].collect()] == [("m2", '{"entry":"icon"}')]
    strict, _ = logs.parsed(lines, strict=True)
    with pytest.raises(Exception, match="MALFORMED"):
        strict.collect()


def test_scalars(spark):
    from tidemark.functions import scalars as s

    row = spark.range(1).select(
        s.amount(F.lit("2"), F.lit("244.00")).alias("amount"), s.blank(F.lit(None).cast("string")).alias("null"), s.blank(F.lit("")).alias("empty"), s.blank(F.lit(" ")).alias("space"),
        s.text_to_ms(F.lit("2023-07-05 01:01:01")).alias("ms"), s.text_to_ms(F.lit("2023-07-05")).alias("day"), s.ms_to_text(F.lit(1_688_490_061_000)).alias("text"),
        s.whole_days(F.lit(datetime(2024, 1, 9, 12)), F.lit(datetime(2024, 1, 1))).alias("days"), s.as_json(F.lit(1).alias("a"), F.lit(None).alias("b")).alias("json"),
        s.words(F.lit("Red, red  SHOES")).alias("words"),
    ).first()
    assert (row["amount"], row["null"], row["empty"], row["space"]) == ("488.0000", True, True, False)
    assert (row["ms"], row["day"], row["text"]) == (1_688_490_061_000, 1_688_486_400_000, "2023-07-04 17:01:01")
    assert (row["days"], row["json"], row["words"]) == (8, '{"a":1}', ["red", "red", "shoes"])


def test_returning_users(spark):
    from tidemark.operators.state import returning

    base = datetime(2024, 1, 1, 10)
    days = [0, 0, 1, 8, 16, 25]
    rows = [("u", base.replace(day=1 + d)) for d in days]
    got = returning(spark.createDataFrame(rows, "uid string, ts timestamp"), "uid", "ts", ["ts"]).orderBy("ts").collect()
    assert [(r["ts"].day - 1, r["back"]) for r in got] == [(0, 0), (1, 0), (8, 0), (16, 1), (25, 1)]


def test_status_transitions_and_carts(spark):
    from tidemark.operators.cdc import added, became
    from tidemark.sources.readers import cdc

    lines = [
        '{"table":"t","type":"update","ts":1,"data":{"id":"1","s":"1003"},"old":{"s":"1001"}}',
        '{"table":"t","type":"update","ts":1,"data":{"id":"2","s":"1003"},"old":{"s":"1002"}}',
        '{"table":"t","type":"update","ts":1,"data":{"id":"3","s":"1003"},"old":{"x":"1"}}',
        '{"table":"t","type":"insert","ts":1,"data":{"id":"4","n":"5"}}',
        '{"table":"t","type":"update","ts":1,"data":{"id":"5","n":"7"},"old":{"n":"5"}}',
        '{"table":"t","type":"update","ts":1,"data":{"id":"6","n":"3"},"old":{"n":"5"}}',
        '{"table":"t","type":"update","ts":1,"data":{"id":"7","n":"3"},"old":{"x":"5"}}',
    ]
    rows = cdc(spark.createDataFrame([(x,) for x in lines], "value string"))
    ids = lambda df: [r[0] for r in df.select(F.col("data")["id"]).collect()]
    assert ids(rows.where(became("s", "1003", "1001"))) == ["1"] and ids(rows.where(became("s", "1003"))) == ["1", "2"]
    assert [r["n"] for r in rows.withColumn("n", added("n")).where("n is not null").select("n").collect()] == [5, 2]


def test_config_and_routing(spark):
    from tidemark.functions.schemas import FACT_CONFIG
    from tidemark.plans.dwd import routed_facts
    from tidemark.sources.readers import config_changes

    route = '{"source_table":"%s","source_type":"insert","sink_table":"%s","sink_columns":"id"}'
    lines = ['{"op":"r","before":null,"after":%s}' % (route % ("a", "t1")), '{"op":"u","before":null,"after":%s}' % (route % ("a", "t2")), '{"op":"d","before":%s,"after":null}' % (route % ("b", "t3"))]
    config = config_changes(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), FACT_CONFIG).withColumn("at", F.monotonically_increasing_id())
    old = spark.createDataFrame([("b", "insert", "old_b", "id"), ("c", "insert", "old_c", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    topic = spark.createDataFrame([(t, k, {"id": t}) for t in "abc" for k in ("insert", "update")], "`table` string, type string, data map<string,string>")
    got = {(r["topic"], r["value"]) for r in routed_facts(topic, config, old, "at").collect()}
    assert got == {("t2", '{"id":"a"}'), ("old_c", '{"id":"c"}')}


def test_missing_dimension_keys(spark):
    from tidemark.operators.joins import enrich_chain

    rows = spark.createDataFrame([(1,), (2,), (None,)], "sku long")
    sku = spark.createDataFrame([(1, "s1", 9)], "id long, name string, spu long")
    spu = spark.createDataFrame([(9, "p9")], "id long, name string")
    got = enrich_chain(rows, [(sku, "sku", "id", {"name": "sku_name", "spu": "spu_id"}), (spu, "spu_id", "id", {"name": "spu_name"})])
    assert sorted((r["sku"] or 0, r["sku_name"], r["spu_name"]) for r in got.collect()) == [(0, None, None), (1, "s1", "p9"), (2, None, None)]
