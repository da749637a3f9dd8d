"""Nulls in states, the order of configuration changes, and jobs whose configuration changes while they run."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row

T0 = datetime(2024, 3, 1, 10)


class Kept:
    """A value state as the processors see it."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def through(processor, *batches):
    processor._state = Kept()
    return [r for rows in batches for r in processor.handleInputRows(("k",), iter(rows), None)]


@pytest.mark.parametrize("kind,zero", [("decimal(16,2)", Decimal), ("double", float), ("bigint", int)])
def test_null_measures_are_zero(spark, kind, zero):
    from tidemark.operators.state import deltas
    from tidemark.streaming.state import Deltas

    values = [10, None, 12]
    rows = spark.createDataFrame([(i, "k", None if v is None else zero(v)) for i, v in enumerate(values)], f"i int, k string, v {kind}")
    assert sum(r["v"] for r in deltas(rows, ["k"], ["v"], ["i"]).collect()) == 12
    each = [Row(i=i, k="k", v=None if v is None else zero(v)) for i, v in enumerate(values)]
    assert sum(r["v"] for r in through(Deltas(rows.schema, ["i"], ["v"], None, None), each[:2], each[2:])) == 12


def test_ties_with_nulls_in_a_stream(spark):
    from tidemark.streaming.state import FirstOfDay

    schema = spark.createDataFrame([], "et timestamp, page_id string, last_day date").schema
    rows = [Row(et=T0, page_id=p) for p in ("home", None, "cart", None)] + [Row(et=T0 + timedelta(days=1), page_id=None)]
    got = through(FirstOfDay(schema, ["et", "page_id"], "et", True), rows)
    assert [r["page_id"] for r in got] == [None, None, "cart", "home", None]
    assert [r["last_day"] for r in got] == [None, *[T0.date()] * 4]


def test_first_of_day_with_nulls_and_ties(spark):
    from tidemark.operators.state import first_of_day, repaired_visitors

    day = timedelta(days=1)
    rows = [(1, "a", T0, "0"), (2, "a", T0, "1"), (3, "a", T0 + day, "1"), (4, None, T0, "1"), (5, None, T0 + day, "1"), (6, "b", None, "1"), (7, "b", T0, None), (8, "a", T0 + 3 * day, None)]
    frame = spark.createDataFrame(rows, "id long, user string, ts timestamp, is_new string")
    got = {r["id"]: r["last_day"] for r in first_of_day(frame, ["user"], "ts", ["ts", "id"]).collect()}
    assert got == {1: None, 3: T0.date(), 8: (T0 + day).date(), 4: None, 5: T0.date(), 7: None}
    fixed = {r["id"]: r["is_new"] for r in repaired_visitors(frame, "user", "ts", "is_new", ["ts", "id"]).collect()}
    assert fixed == {1: "0", 2: "0", 3: "0", 4: "1", 5: "0", 6: "1", 7: None, 8: None}


def change(op, at, sink, columns="id", table="comment_info"):
    row = {"source_table": table, "source_type": "insert", "sink_table": sink, "sink_columns": columns, "sink_family": "info", "sink_row_key": "id"}
    return json.dumps({"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row, "ts_ms": at})


@pytest.mark.parametrize("changes,want", [
    ([("d", 1, "x"), ("c", 2, "x")], ["x"]), ([("c", 1, "x"), ("d", 2, "x")], []), ([("u", 2, "a"), ("u", 1, "z")], ["a"]), ([("r", 1, "a"), ("d", 3, "a"), ("u", 2, "b")], []),
])
def test_configuration_changes_are_met_in_order_of_time(spark, changes, want):
    from tidemark.operators.cdc import active_config
    from tidemark.streaming.jobs import fact_config

    lines = spark.createDataFrame([(change(*c),) for c in changes], "value string")
    assert [r["sink_table"] for r in active_config(fact_config(lines), ["source_table", "source_type"], "at").collect()] == want


def record(table, ts, data):
    return json.dumps({"database": "shop", "table": table, "type": "insert", "ts": ts, "data": data, "old": None})


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_jobs_follow_a_live_configuration(spark, tmp_path):
    """Two rounds of both jobs: the second one meets a route that is gone, and one that is new."""
    from tidemark.streaming.jobs import start, start_config
    from tidemark.streaming.sinks import read_table

    at = lambda x: str(tmp_path / x)
    rounds = [
        ({"facts": [change("c", 1, "dwd_comment")], "dims": [change("c", 1, "dim_cart", "id,sku_num", "cart_info")]}, "1"),
        ({"facts": [change("d", 2, "dwd_comment"), change("c", 3, "dwd_cart", table="cart_info")], "dims": []}, "2"),
    ]
    for configs, n in rounds:
        for kind, name in (("facts", "fact_config"), ("dims", "dim_config")):
            put(tmp_path / kind, f"{n}.txt", configs[kind])
            start_config(name, spark, at(kind), at(f"table_{kind}"), at(f"mark_{kind}"), available_now=True).awaitTermination()
        put(tmp_path / "db", f"{n}.txt", [record("comment_info", 10, {"id": f"m{n}"}), record("cart_info", 10 + int(n), {"id": f"c{n}", "sku_num": n})])
        live = {"fact_config": lambda: read_table(spark, at("table_facts")), "dim_config": lambda: read_table(spark, at("table_dims"))}
        for job in ("fact_route", "dimensions"):
            for q in start(job, spark, {"topic_db": at("db")}, live, at(job), at(f"mark_{job}"), available_now=True):
                q.awaitTermination()
    routed = {(r["topic"], json.loads(r["value"])["id"]) for r in spark.read.option("basePath", at("fact_route")).text(at("fact_route")).collect()}
    assert routed == {("dwd_comment", "m1"), ("dwd_cart", "c2")}
    assert {(r["row_key"], r["sku_num"]) for r in read_table(spark, at("dimensions/dim_cart")).collect()} == {("c1", "1"), ("c2", "2")}
    assert spark.table("dim_cart").columns == ["row_key", "id", "sku_num"]
    spark.sql("drop table dim_cart")


def test_names_of_tables_are_quoted(spark):
    from tidemark.streaming.sinks import sync_tables

    make = sync_tables()
    make(spark.createDataFrame([("d", 2, "dim_q", None), ("c", 1, "dim_q", "a`b, c d")], "op string, at long, sink_table string, sink_columns string").where("at = 1"), 0)
    assert spark.table("dim_q").columns == ["row_key", "a`b", "c d"]
    make(spark.createDataFrame([("u", 3, "dim_q", "late"), ("c", 1, "dim_q", "first")], "op string, at long, sink_table string, sink_columns string"), 1)
    assert spark.table("dim_q").columns == ["row_key", "late"]
    spark.sql("drop table dim_q")


def test_log_job_repairs_flags_and_splits_in_one_pass(spark, tmp_path):
    from tidemark.streaming.jobs import start
    from tidemark.streaming.state import use_rocksdb

    use_rocksdb(spark)
    ms = int(T0.timestamp() * 1000)
    line = lambda mid, at, new, **more: json.dumps({"common": {"mid": mid, "is_new": new}, "ts": at} | more)
    page = {"page": {"page_id": "home"}}
    day = 86_400_000
    put(tmp_path / "log", "1.txt", [line("a", ms, "1", **page), line("b", ms, "0", err="e"), "cut"])
    marks = str(tmp_path / "marks")
    for n in (1, 2):
        queries = start("log_split", spark, {"topic_log": str(tmp_path / "log")}, {}, str(tmp_path / "out"), marks, available_now=True)
        assert len(queries) == 2
        for q in queries:
            q.awaitTermination()
        put(tmp_path / "log", "2.txt", [line("a", ms + day, "1", displays=[{"item": "i"}], **page), line("b", ms + 5, "1", start="s"), line("c", ms - 9 * day, "1", **page)])
    read = lambda part: sorted((r["mid"], r["is_new"]) for r in spark.read.option("basePath", str(tmp_path / "out" / part)).json(str(tmp_path / "out" / part)).collect())
    assert read("page") == [("a", "0"), ("a", "1"), ("c", "1")] and read("display") == [("a", "0")]
    assert read("err") == [("b", "0")] and read("start") == [("b", "0")]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out" / "dirty")).collect()] == ["cut"]


def test_jdbc_reader_and_console_sink(spark, tmp_path):
    """The reader hands over url, query and options; the console gets the rows of a stream."""
    from tidemark.sources.readers import jdbc_snapshot, strings
    from tidemark.streaming.sinks import console

    with pytest.raises(Exception, match="(?i)driver"):
        jdbc_snapshot(spark, "jdbc:nothing://host/db", "select 1", fetchsize="10").collect()
    put(tmp_path / "in", "a.txt", ["one", "two"])
    query = console(strings(spark, str(tmp_path / "in"), stream=True)).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None and sum(p["numInputRows"] for p in query.recentProgress) == 2
