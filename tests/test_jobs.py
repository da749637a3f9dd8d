"""Every job runs on batch frames; two of them as streams to their sinks."""

import json

import pytest

from tidemark.streaming.jobs import JOBS

T = 1_700_000_000
DB = [
    ("order_detail", "insert", {"id": "d1", "order_id": "o1", "sku_id": "s1", "sku_name": "n", "create_time": "2023-11-14 22:13:20", "sku_num": "2", "order_price": "3.50", "split_total_amount": "7.00"}, None),
    ("order_info", "insert", {"id": "o1", "user_id": "u1", "province_id": "p1", "order_status": "1001"}, None),
    ("order_info", "update", {"id": "o1", "user_id": "u1", "province_id": "p1", "order_status": "1003", "operate_time": "2023-11-14 22:14:00"}, {"order_status": "1001"}),
    ("order_info", "update", {"id": "o2", "user_id": "u1", "province_id": "p1", "order_status": "1005"}, {"order_status": "1002"}),
    ("order_info", "update", {"id": "o2", "user_id": "u1", "province_id": "p1", "order_status": "1006"}, {"order_status": "1005"}),
    ("payment_info", "update", {"user_id": "u1", "order_id": "o1", "payment_type": "1", "callback_time": "2023-11-14 22:13:25", "payment_status": "1602"}, {"payment_status": "1601"}),
    ("order_refund_info", "insert", {"id": "r1", "user_id": "u1", "order_id": "o2", "sku_id": "s1", "refund_type": "1", "refund_num": "1", "refund_amount": "2", "refund_reason_type": "1", "create_time": "2023-11-14 22:13:20"}, None),
    ("order_refund_info", "update", {"id": "r1", "order_id": "o2", "sku_id": "s1", "refund_num": "1", "refund_status": "0705"}, {"refund_status": "0702"}),
    ("refund_payment", "update", {"id": "x1", "order_id": "o2", "sku_id": "s1", "payment_type": "1", "callback_time": "2023-11-14 22:13:20", "total_amount": "2", "refund_status": "1602"}, {"refund_status": "1601"}),
    ("cart_info", "insert", {"id": "c1", "user_id": "u1", "sku_id": "s1", "sku_num": "3"}, None),
    ("comment_info", "insert", {"id": "m1", "user_id": "u1", "sku_id": "s1", "appraise": "1", "comment_txt": "good"}, None),
]
PAGE = {"common": {"mid": "m1", "uid": "u1", "is_new": "1", "vc": "v", "ch": "c", "ar": "a"}, "page": {"page_id": "home", "last_page_id": "search", "item": "Red shoes", "item_type": "keyword", "during_time": 7}, "ts": T * 1000}
LOGIN = {"common": {"mid": "m1", "uid": "u1"}, "page": {"page_id": "good_detail", "last_page_id": "login"}, "ts": T * 1000 + 1}
DETAIL = {"id": "d1", "order_id": "o1", "user_id": "u1", "sku_id": "s1", "province_id": "p1", "split_original_amount": "7.0000", "split_total_amount": "7.00", "ts": T}
LINES = {
    "topic_db": [{"database": "shop", "table": t, "type": k, "ts": T + 1, "data": d, "old": o} for t, k, d, o in DB],
    "topic_log": [PAGE, LOGIN, "cut"], "page_log": [PAGE, LOGIN], "order_detail": [DETAIL, DETAIL | {"ts": T + 1}],
    "order_refund": [{"order_id": "o2", "user_id": "u1", "sku_id": "s1", "ts": T}], "payment": [{"order_detail_id": "d1", "user_id": "u1", "ts": T}],
    "cart_add": [{"id": "c1", "user_id": "u1", "ts": T}], "user_register": [{"user_id": "u1", "create_time": "2023-11-14 22:13:20"}, {"user_id": "u2", "create_time": str(T * 1000)}],
}


def dims(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "dic": spark.sql("select '1' dic_code, named_struct('dic_name', 'one') info"), "province": frame([("p1", "North")], "id string, name string"),
        "sku": frame([("s1", "shoe", "q1", "t1", "k3")], "id string, sku_name string, spu_id string, tm_id string, category3_id string"), "spu": frame([("q1", "line")], "id string, spu_name string"),
        "trademark": frame([("t1", "brand")], "id string, tm_name string"), "category3": frame([("k3", "three", "k2")], "id string, name string, category2_id string"),
        "category2": frame([("k2", "two", "k1")], "id string, name string, category1_id string"), "category1": frame([("k1", "one")], "id string, name string"),
        "dim_config": frame([("r", "cart_info", "dim_cart", "id,sku_num", "info", "id")], "op string, source_table string, sink_table string, sink_columns string, sink_family string, sink_row_key string"),
        "fact_config": frame([("r", "comment_info", "insert", "dwd_comment", "id")], "op string, source_table string, source_type string, sink_table string, sink_columns string"),
    }


def lines(spark, name):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in LINES[name]], "value string")


WANT = {"order_details": 1, "order_cancels": 2, "payments": 2, "logins": 1, "keyword_counts": 2, "registrations": 1, "page_views": 2, "province_orders": 1, "log_split": None}


@pytest.mark.parametrize("name", JOBS)
def test_job_on_batch_frames(spark, name):
    job = JOBS[name]
    made = job.build({t: lines(spark, t) for t in job.topics}, dims(spark))
    for part, rows in (made if isinstance(made, dict) else {name: made}).items():
        n = rows.count()
        if name != "log_split":
            assert n == WANT.get(name, 1), (name, n)
        else:
            assert n == {"page": 2, "dirty": 1}.get(part, 0), part
    if name == "sku_orders":
        assert made.first().asDict()["category1_name"] == "one" and str(made.first()["order_amount"]) == "7.00"


def test_streams_reach_their_sinks(spark, tmp_path):
    from tidemark.streaming.jobs import start
    from tidemark.streaming.sinks import read_table

    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "0.txt").write_text("\n".join(json.dumps(x) for x in LINES["topic_db"]))
    for name, extra in (("cart_adds", {}), ("dimensions", {"dim_columns": {"dim_cart": ["sku_num"]}}), ("fact_route", {})):
        for q in start(name, spark, {"topic_db": str(tmp_path / "db")}, dims(spark), str(tmp_path / name), str(tmp_path / "marks" / name), available_now=True, **extra):
            q.awaitTermination()
    assert [(r["id"], r["sku_num"]) for r in read_table(spark, str(tmp_path / "cart_adds")).collect()] == [("c1", 3)]
    assert [(r["row_key"], r["sku_num"]) for r in read_table(spark, str(tmp_path / "dimensions" / "dim_cart")).collect()] == [("c1", "3")]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fact_route" / "topic=dwd_comment")).collect()][0].startswith('{"id":"m1"')
