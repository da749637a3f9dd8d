"""Streams over several files, one a trigger, against the batch form of the same rows."""

import json
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

T0 = datetime(2024, 3, 1, 23, 59, 30)
EVENTS = "id long, user_id string, ts timestamp, page_id string, last_page_id string, during_time long, is_new string, vc string, ch string, ar string"


def rows():
    out = []
    for i in range(60):
        at = T0 + timedelta(seconds=2 * i) if i < 40 else T0 + timedelta(days=8 + i % 3, seconds=i * 3)
        out.append((i, f"u{i % 4}", at, ["home", "good_detail", "list"][i % 3], [None, "", "login", "home"][i % 4], i if i % 5 else None, "1" if i % 4 else "0", "v1", "web", str(i % 2)))
    return sorted(out, key=lambda r: r[2])


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """(batch, stream): the stream reads four files, in order, and a last row that closes all windows."""
    from tidemark.streaming.state import use_rocksdb

    use_rocksdb(spark)
    folder = tmp_path_factory.mktemp("events")
    data = rows()
    last = (999, "closing", T0 + timedelta(days=30), "none", "none", None, "0", "v0", "none", "none")
    parts = [data[:20], data[20:40], data[40:], [last]]
    import os
    import time

    for n, part in enumerate(parts):
        frame = spark.createDataFrame(part, EVENTS).coalesce(1)
        frame.write.parquet(str(folder / f"p{n}"))
        for f in (folder / f"p{n}").glob("*.parquet"):
            os.utime(f, (time.time() - 1000 + 10 * n,) * 2)
    schema = spark.createDataFrame([], EVENTS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "p*"))
    return spark.createDataFrame(data, EVENTS), stream.withWatermark("ts", "3 seconds")


def drained(spark, frame, tmp_path, name):
    out = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.table(name)


FORMS = {
    "ordering_users": lambda d, e: d.ordering_users(e, "user_id", "ts", ["ts", "id"]),
    "logins": lambda d, e: d.logins(e, "user_id", "ts", ["ts", "id"]),
    "page_views": lambda d, e: d.page_views(e, "user_id", "ts", ["ts", "id"]),
    "home_detail": lambda d, e: d.home_detail_visitors(e, "user_id", "ts", ["ts", "id"]),
    "registrations": lambda d, e: d.registrations(e, "ts"),
}


@pytest.mark.parametrize("name", FORMS)
def test_summaries_agree(spark, events, tmp_path, name):
    from tidemark.plans import dws

    batch, stream = events
    want = Counter(tuple(r) for r in FORMS[name](dws, batch).collect())
    got = drained(spark, FORMS[name](dws, stream), tmp_path, f"s_{name}")
    assert Counter(tuple(r) for r in got.collect() if r["stt"] < "2024-03-20") == want and want


def test_deltas_and_repair_agree(spark, events, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators.state import deltas, repaired_visitors

    for i, form in enumerate([
        lambda e: deltas(e.withColumn("amount", F.col("id").cast("decimal(16,2)")), ["user_id"], ["amount"], ["ts", "id"], "ts", 3600).select("id", "amount"),
        lambda e: repaired_visitors(e, "user_id", "ts", "is_new", ["ts", "id"]).select("id", "is_new"),
    ]):
        want = Counter(tuple(r) for r in form(events[0]).collect())
        got = drained(spark, form(events[1]), tmp_path, f"k_{i}")
        assert Counter(tuple(r) for r in got.collect() if r["id"] != 999) == want


def test_late_rows_are_dropped(spark, tmp_path):
    from tidemark.plans.dws import registrations

    for n, at in enumerate([0, 100, 101, 1, 300]):
        spark.createDataFrame([(T0 + timedelta(seconds=at),)], "ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"d{n}"))
    import os
    import time

    for n in range(5):
        for f in (tmp_path / f"d{n}").glob("*.parquet"):
            os.utime(f, (time.time() - 1000 + 10 * n,) * 2)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d*")).withWatermark("ts", "3 seconds")
    got = drained(spark, registrations(stream, "ts"), tmp_path, "late")
    assert sorted(r["register_ct"] for r in got.collect()) == [1, 2]


def record(table, kind, ts, data, old=None):
    return json.dumps({"database": "shop", "table": table, "type": kind, "ts": ts, "data": data, "old": old})


def topic_lines():
    t = 1_700_000_000
    lines = [
        record("order_detail", "insert", t, {"id": "d1", "order_id": "o1", "sku_id": "s1", "sku_name": "n", "create_time": "2023-11-14 22:13:20", "sku_num": "2", "order_price": "3.50", "split_total_amount": "7.00"}),
        record("order_detail", "insert", t, {"id": "d2", "order_id": "o2", "sku_id": "s2", "sku_name": "n", "create_time": "2023-11-14 22:13:20", "sku_num": "1", "order_price": "1.00", "split_total_amount": "1.00"}),
        record("order_info", "insert", t + 1, {"id": "o1", "user_id": "u1", "province_id": "p1", "order_status": "1001"}),
        record("order_info", "insert", t + 1, {"id": "o2", "user_id": "u2", "province_id": "p2", "order_status": "1001"}),
        record("order_detail_activity", "insert", t + 1, {"order_detail_id": "d1", "activity_id": "a1", "activity_rule_id": "r1"}),
        record("order_detail_coupon", "insert", t + 2, {"order_detail_id": "d2", "coupon_id": "c1"}),
        "no json", "[1, 2]", None,
    ]
    keys = {"order_detail": "id", "order_info": "id", "order_detail_activity": "order_detail_id", "order_detail_coupon": "order_detail_id"}
    # filters are pushed below the watermark, so every table needs later records for its time to move on
    return lines, ["\n".join(record(x, "insert", t + 4000 * i, {k: f"{x}{i}", "order_id": "none"}) for x, k in keys.items()) for i in range(1, 4)]


def test_order_details_stream(spark, tmp_path):
    from tidemark.plans.dwd import order_details
    from tidemark.sources.readers import cdc, strings

    lines, closing = topic_lines()
    batch = cdc(spark.createDataFrame([(x,) for x in lines], "value string").where("value is not null"))
    want = Counter(tuple(r) for r in order_details(batch, "shop").select("id", "user_id", "activity_id", "coupon_id", "split_original_amount", "date_id").collect())
    assert want == Counter([("d1", "u1", "a1", None, "7.0000", "2023-11-14"), ("d2", "u2", None, "c1", "1.0000", "2023-11-14")])
    import os
    import time

    for n, part in enumerate([[x for x in lines if x], *[[c] for c in closing]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        f = tmp_path / "in" / f"{n}.txt"
        f.write_text("\n".join(part))
        os.utime(f, (time.time() - 1000 + 10 * n,) * 2)
    stream = cdc(strings(spark, str(tmp_path / "in"), stream=True, maxFilesPerTrigger="1"))
    details = order_details(stream, "shop", within="30 seconds").select("id", "user_id", "activity_id", "coupon_id", "split_original_amount", "date_id")
    assert Counter(tuple(r) for r in drained(spark, details, tmp_path, "details").collect()) == want


def test_payment_bounds(spark):
    from tidemark.plans.dwd import order_details, payments
    from tidemark.sources.readers import cdc

    lines, _ = topic_lines()
    t = 1_700_000_000
    pay = lambda i, at: record("payment_info", "update", at, {"user_id": f"u{i}", "order_id": "o1", "payment_type": "1101", "payment_status": "1602"}, {"payment_status": "1601"})
    lines = [x for x in lines if x] + [pay(1, t + 1800), pay(2, t + 1801), pay(3, t - 5), pay(4, t - 6)]
    topic = cdc(spark.createDataFrame([(x,) for x in lines], "value string"))
    topic = topic.withColumn("et", topic["et"])
    dic = spark.sql("select '1101' dic_code, named_struct('dic_name', 'card') info")
    details = order_details(topic, "shop", within="30 seconds")
    assert sorted(r["user_id"] for r in payments(topic, details, dic).collect()) == ["u1", "u3"]


def test_upsert_replays(spark, tmp_path):
    from tidemark.streaming.sinks import dim_upsert, json_lines, read_table, upsert

    write = upsert(str(tmp_path / "t"), ["k"], ["ts"], 4)
    one = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "k string, ts long, v string")
    two = spark.createDataFrame([("a", 3, None), ("c", 3, "n")], "k string, ts long, v string")
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        write(batch, n)
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / "t")).select("k", "v").collect()) == [("a", None), ("b", "y"), ("c", "n")]

    dims = dim_upsert(str(tmp_path / "d"), ["k"], ["ts"], ["p", "q"], 4)
    kind = "k string, type string, ts long, p string, q string"
    steps = [
        [("a", "insert", 1, "p1", "q1"), ("b", "insert", 1, "p1", None)],
        [("a", "update", 2, None, "q2"), ("b", "delete", 2, None, None), ("c", "bootstrap-insert", 2, "p", None)],
        [("b", "insert", 3, None, "again"), ("c", "delete", 3, None, None)],
    ]
    for n, step in enumerate(steps):
        for _ in range(2):
            dims(spark.createDataFrame(step, kind), n)
    dims(spark.createDataFrame(steps[0], kind), 0)
    got = sorted(tuple(r) for r in read_table(spark, str(tmp_path / "d")).select("k", "p", "q").collect())
    assert got == [("a", "p1", "q2"), ("b", None, "again")]

    lines = json_lines(str(tmp_path / "j"))
    for _ in range(2):
        lines(one, 5)
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_sync_tables(spark):
    from tidemark.streaming.sinks import sync_tables

    make = sync_tables()
    make(spark.createDataFrame([("c", "dim_x", "id,name"), ("r", "dim_y", None)], "op string, sink_table string, sink_columns string"), 0)
    spark.sql("insert into dim_x values ('k', '1', 'n')")
    make(spark.createDataFrame([("r", "dim_x", "id,name"), ("d", "dim_y", None)], "op string, sink_table string, sink_columns string"), 1)
    assert spark.table("dim_x").count() == 1 and not spark.catalog.tableExists("dim_y")
    make(spark.createDataFrame([("u", "dim_x", "id")], "op string, sink_table string, sink_columns string"), 2)
    assert spark.table("dim_x").count() == 0 and spark.table("dim_x").columns == ["row_key", "id"]
    spark.sql("drop table dim_x")


def test_sum_of_deltas_is_last_value(spark):
    from tidemark.operators.state import deltas

    data = [("d", i, Decimal(v)) for i, v in enumerate(["5.00", "5.00", "5.00", "7.50"])]
    got = deltas(spark.createDataFrame(data, "k string, i int, v decimal(16,2)"), ["k"], ["v"], ["i"]).collect()
    assert sum(r["v"] for r in got) == Decimal("7.50")
