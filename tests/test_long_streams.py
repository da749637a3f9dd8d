"""Streams that run for long: states that expire, states that begin with a history, exact distinct counts, corrected joins."""

import json
import os
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

T0 = datetime(2024, 3, 1, 12)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    from tidemark.streaming.state import use_rocksdb

    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream_of(spark, folder, parts, schema, delay="3 seconds"):
    """(stream, batch): a file a trigger."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"p{n}"))
        for f in (folder / f"p{n}").glob("*.parquet"):
            os.utime(f, (time.time() - 1000 + 10 * n,) * 2)
    kind = spark.createDataFrame([], schema).schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder / "p*"))
    return stream.withWatermark("ts", delay), spark.createDataFrame([r for p in parts for r in p], schema)


def drained(spark, frame, tmp_path, name):
    """Rows, and the number of state rows after each micro-batch, those of the first stateful operator last."""
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in query.recentProgress]
    return [tuple(r) for r in spark.table(name).collect()], states


def test_amounts_are_forgotten_after_the_gap(spark, tmp_path):
    from tidemark.operators.state import deltas

    at = lambda s: T0 + timedelta(seconds=s)
    parts = [[(f"d{i}", at(i % 5), i) for i in range(200)], [("d1", at(30), 7), ("d2", at(62), 9)], [("d1", at(80), 8), ("d3", at(200), 1)], [("d1", at(143), 5)], [("x", at(900), 0)], [("x", at(1800), 0)]]
    stream, batch = stream_of(spark, tmp_path, parts, "id string, ts timestamp, v int", "100 seconds")
    form = lambda rows: deltas(rows, ["id"], ["v"], ["ts"], "ts", 60)
    got, states = drained(spark, form(stream), tmp_path, "gap")
    assert Counter(got) == Counter(tuple(r) for r in form(batch).collect())
    rows = [s[0] for s in states]
    assert max(rows) >= 200 and rows[-1] == 1


def test_days_are_forgotten_where_they_do_not_count(spark, tmp_path):
    from tidemark.plans.dws import cart_users, page_views

    day = timedelta(days=1)
    parts = [[(f"u{i}", T0 + timedelta(seconds=i), i) for i in range(100)], [("u1", T0 + day, 200), ("u2", T0 + day, 201)], [("u1", T0 + 4 * day, 300)], [("u1", T0 + 9 * day, 301)], [("end", T0 + 30 * day, 999)]]
    stream, batch = stream_of(spark, tmp_path, parts, "mid string, ts timestamp, id long")
    got, states = drained(spark, cart_users(stream, "mid", "ts", ["ts", "id"]), tmp_path, "days")
    want = Counter(tuple(r) for r in cart_users(batch, "mid", "ts", ["ts", "id"]).collect() if r["stt"] < "2024-03-20")
    assert Counter(got) == want
    # the state of the days is the second operator from the sink
    assert max(max(s) for s in states) >= 100 and max(states[-1]) <= 3
    more = {c: F.lit("x") for c in ("vc", "ch", "ar", "is_new", "last_page_id")} | {"during_time": F.lit(1).cast("long")}
    got, states = drained(spark, page_views(stream.withColumns(more), "mid", "ts", ["ts", "id"]), tmp_path, "views")
    want = Counter(tuple(r) for r in page_views(batch.withColumns(more), "mid", "ts", ["ts", "id"]).collect() if r["stt"] < "2024-03-20")
    assert Counter(got) == want and max(states[-1]) <= 3


HISTORY = [(i, f"u{i % 7}", T0 + timedelta(days=i % 3, seconds=i), "1" if i % 2 else "0") for i in range(40)]
LATER = [(100 + i, f"u{i % 9}", T0 + timedelta(days=3 + 5 * (i % 3), seconds=i), "1" if i % 3 else "0") for i in range(40)]
FORMS = {
    "new": lambda d, rows, **h: d.ordering_users(rows, "user", "ts", ["ts", "id"], **h),
    "back": lambda d, rows, **h: d.logins(rows.withColumn("last_page_id", F.lit("")), "user", "ts", ["ts", "id"], **{k: v.withColumn("last_page_id", F.lit("")) for k, v in h.items()}),
}


@pytest.mark.parametrize("name", FORMS)
def test_a_stream_with_a_history_goes_on_as_batch(spark, tmp_path, name):
    from tidemark.plans import dws

    schema = "id long, user string, ts timestamp, is_new string"
    stream, _ = stream_of(spark, tmp_path, [sorted(LATER, key=lambda r: r[2]), [(999, "end", T0 + timedelta(days=60), "0")]], schema)
    past, every = spark.createDataFrame(HISTORY, schema), spark.createDataFrame(HISTORY + LATER, schema)
    got, _ = drained(spark, FORMS[name](dws, stream, history=past), tmp_path, f"h_{name}")
    begin = (T0 + timedelta(days=3)).strftime("%Y-%m-%d %H:%M:%S")
    assert Counter(got) == Counter(tuple(r) for r in FORMS[name](dws, every).collect() if r["stt"] >= begin)


def test_flags_and_amounts_with_a_history(spark, tmp_path):
    from tidemark.operators.state import deltas, repaired_visitors

    schema = "id long, user string, ts timestamp, is_new string"
    stream, _ = stream_of(spark, tmp_path, [sorted(LATER, key=lambda r: r[2])], schema)
    past, every = spark.createDataFrame(HISTORY, schema), spark.createDataFrame(HISTORY + LATER, schema)
    flags = lambda rows, **h: repaired_visitors(rows, "user", "ts", "is_new", ["ts", "id"], **h).select("id", "is_new")
    got, _ = drained(spark, flags(stream, history=past), tmp_path, "h_flags")
    assert Counter(got) == Counter(tuple(r) for r in flags(every).where("id >= 100").collect())
    for gap in (None, 200_000):
        sums = lambda rows, gap=gap, **h: deltas(rows.withColumn("v", F.col("id") * 3), ["user"], ["v"], ["ts", "id"], "ts", gap, **h).select("id", "v")
        got, _ = drained(spark, sums(stream, history=past.withColumn("v", F.col("id") * 3)), tmp_path, f"h_sums{gap}")
        assert Counter(got) == Counter(tuple(r) for r in sums(every).where("id >= 100").collect())


def test_distinct_counts_have_a_state_row_each(spark, tmp_path):
    from tidemark.plans.dws import province_sums

    row = lambda i, province, order, s: (i, province, order, T0 + timedelta(seconds=s), i)
    parts = [[row(i, "hot", f"o{i % 150}", i % 9) for i in range(300)] + [row(500, "p", None, 2), row(501, None, "o1", 2)], [row(600, "hot", "o1", 15), row(601, "hot", "o1", 16)], [row(999, "end", "e", 100)], [row(1000, "end", "e", 200)]]
    schema = "id long, province_id string, order_id string, ts timestamp, n int"
    stream, batch = stream_of(spark, tmp_path, parts, schema)
    form = lambda rows: province_sums(rows.withColumn("split_total_amount", F.col("n").cast("decimal(16,2)")), ["id"], "ts", ["ts"], max_gap=60)
    got, states = drained(spark, form(stream), tmp_path, "distinct")
    names = form(batch).columns
    assert form(stream).columns == names or set(form(stream).columns) == set(names)
    at = [form(stream).columns.index(c) for c in names]
    want = Counter(tuple(r) for r in form(batch).collect() if r["province_id"] != "end")
    assert Counter(tuple(r[i] for i in at) for r in got if "end" not in r) == want
    assert max(max(s) for s in states) >= 150


def record(table, ts, data):
    return json.dumps({"database": "shop", "table": table, "type": "insert", "ts": ts, "data": data, "old": None})


def test_left_joins_are_corrected(spark, tmp_path):
    from tidemark.streaming.jobs import start
    from tidemark.streaming.sinks import read_table

    t = 1_700_000_000
    detail = lambda i: record("order_detail", t, {"id": f"d{i}", "order_id": "o1", "sku_id": "s", "sku_name": "n", "create_time": "2023-11-14 22:13:20", "sku_num": "2", "order_price": "3.50", "split_total_amount": "7.00"})
    rounds = [
        [detail(1), detail(2), record("order_info", t + 1, {"id": "o1", "user_id": "u1", "province_id": "p1"}), record("order_detail_activity", t, {"order_detail_id": "d1", "activity_id": "a1", "activity_rule_id": "r1"})],
        [record("order_detail_coupon", t + 2, {"order_detail_id": "d1", "coupon_id": "c1"})],
        [record("order_detail_activity", t + 2, {"order_detail_id": "d2", "activity_id": "a2", "activity_rule_id": "r2"}), record("order_detail_coupon", t + 1, {"order_detail_id": "other", "coupon_id": "c9"})],
    ]
    want = [{"d1": ("a1", None), "d2": (None, None)}, {"d1": ("a1", "c1"), "d2": (None, None)}, {"d1": ("a1", "c1"), "d2": ("a2", None)}]
    (tmp_path / "db").mkdir()
    for n, lines in enumerate(rounds):
        (tmp_path / "db" / f"{n}.txt").write_text("\n".join(lines))
        for q in start("order_details", spark, {"topic_db": str(tmp_path / "db")}, {}, str(tmp_path / "out"), str(tmp_path / "marks"), available_now=True):
            q.awaitTermination()
        rows = read_table(spark, str(tmp_path / "out")).collect()
        assert {r["id"]: (r["activity_id"], r["coupon_id"]) for r in rows} == want[n], n
        assert {r["user_id"] for r in rows} == {"u1"} and {r["split_original_amount"] for r in rows} == {"7.0000"}
    # once the watermark has passed, nothing of a detail is kept
    keys = {"order_detail": "id", "order_info": "id", "order_detail_activity": "order_detail_id", "order_detail_coupon": "order_detail_id"}
    for n in (1, 2, 3):
        (tmp_path / "db" / f"z{n}.txt").write_text("\n".join(record(x, t + 4000 * n, {k: f"{x}{n}", "order_id": "none"}) for x, k in keys.items()))
        (query,) = start("order_details", spark, {"topic_db": str(tmp_path / "db")}, {}, str(tmp_path / "out"), str(tmp_path / "marks"), available_now=True)
        query.awaitTermination()
    kept = [o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert kept and kept[0] <= 6


def test_records_of_a_batch_that_comes_again_are_read_once(spark, tmp_path):
    from tidemark.sources.readers import once
    from tidemark.streaming.sinks import marked

    batches = [(0, ["a", "a", "b"]), (1, ["a", "c"]), (1, ["c", "a"]), (0, ["b", "a", "a"]), (2, ["c"])]
    for n, (batch_id, values) in enumerate(batches):
        rows = spark.createDataFrame([(v,) for v in values], "value string")
        for copy, writer in enumerate(("q", "other")[: 1 + (n == 1)]):
            out = marked(rows, batch_id, writer).withColumn("timestamp", F.lit(T0 + timedelta(seconds=n)))
            out.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}{copy}"))
    plain = spark.createDataFrame([("x",), ("x",)], "value string").withColumns({"headers": F.lit(None).cast("array<struct<key:string,value:binary>>"), "timestamp": F.lit(T0)})
    plain.coalesce(1).write.parquet(str(tmp_path / "in" / "plain"))
    want = Counter([("a",)] * 4 + [("b",)] + [("c",)] * 3 + [("x",)] * 2)
    schema = plain.schema
    batch = spark.read.schema(schema).parquet(*map(str, (tmp_path / "in").iterdir()))
    assert Counter(tuple(r) for r in once(batch, "1 hour").collect()) == want
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    got, _ = drained(spark, once(stream, "1 hour"), tmp_path, "once")
    assert Counter(got) == want
