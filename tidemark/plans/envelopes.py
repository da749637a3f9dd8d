"""Change records and app logs derived from the star tables, as inputs of the detail layer."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATABASE = "shop"
STAMP = "yyyy-MM-dd HH:mm:ss"


def _map(**columns: Column) -> Column:
    pairs = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])
    whole = reduce(and_, [v.isNotNull() for v in columns.values()])
    return F.when(whole, pairs).otherwise(F.map_filter(pairs, lambda _, v: v.isNotNull()))  # a filter costs more than all else here


def envelope(rows: DataFrame, table: str, kind: str | Column, ts: Column, data: Column, old: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    old = F.lit(None).cast("map<string,string>") if old is None else old
    return rows.select(F.lit(DATABASE).alias("database"), F.lit(table).alias("table"), kind.alias("type"), F.unix_seconds(ts.cast("timestamp")).alias("ts"), data.alias("data"), old.alias("old"))


def detail_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def order_records(orders: DataFrame) -> DataFrame:
    """An insert of every order, and an update from 1001 to the status that its letter stands for: F 1003, P 1005, O 1006."""
    at, when = F.col("o_orderdate"), F.date_format("o_orderdate", STAMP)
    base = {"id": F.col("o_orderkey"), "user_id": F.col("o_custkey"), "province_id": F.col("o_custkey") % 25}
    status = F.when(F.col("o_orderstatus") == "F", "1003").when(F.col("o_orderstatus") == "P", "1005").otherwise("1006")
    made = envelope(orders, "order_info", "insert", at, _map(**base, order_status=F.lit("1001")))
    done = envelope(orders, "order_info", "update", at, _map(**base, order_status=status, operate_time=when), _map(order_status=F.lit("1001")))
    return made.unionByName(done)


def detail_records(lines: DataFrame) -> DataFrame:
    """Inserts of the first line of every detail id, with activities for discounts and coupons for taxes above 5 percent."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = lines.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    at = F.col("l_shipdate")
    price = F.col("l_extendedprice").cast("decimal(16,2)")
    data = _map(
        id=detail_id(), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), sku_name=F.concat(F.lit("sku "), F.col("l_partkey").cast("string")), create_time=F.date_format(at, STAMP),
        sku_num=F.col("l_quantity").cast("int"), order_price=price, split_total_amount=price, split_activity_amount=F.col("l_discount").cast("decimal(16,2)"),
        split_coupon_amount=F.col("l_tax").cast("decimal(16,2)"),
    )
    rows = envelope(lines, "order_detail", "insert", at, data)
    act = lines.where("l_discount > 0.05")
    act = envelope(act, "order_detail_activity", "insert", at, _map(order_detail_id=detail_id(), activity_id=F.col("l_linenumber"), activity_rule_id=F.col("l_suppkey")))
    cou = lines.where("l_tax > 0.05")
    cou = envelope(cou, "order_detail_coupon", "insert", at, _map(order_detail_id=detail_id(), coupon_id=F.col("l_suppkey")))
    return rows.unionByName(act).unionByName(cou)


def refund_records(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Refund requests for returned lines, and their payment: both records of both tables, one for each order and sku."""
    lines = lines.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").cast("int").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(16,2)")).alias("amount"), F.max("l_shipdate").alias("at")
    )
    ident = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    lines = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    at, when = F.col("at"), F.date_format("at", STAMP)
    base = {
        "id": ident, "user_id": F.col("o_custkey"), "order_id": F.col("l_orderkey"), "sku_id": F.col("l_partkey"), "refund_num": F.col("n"), "refund_amount": F.col("amount"),
        "refund_type": F.col("l_partkey") % 5, "refund_reason_type": F.col("l_orderkey") % 5, "refund_reason_txt": F.lit("returned"), "create_time": when,
    }
    asked = envelope(lines, "order_refund_info", "insert", at, _map(**base))
    done = envelope(lines, "order_refund_info", "update", at, _map(**base, refund_status=F.lit("0705")), _map(refund_status=F.lit("0702")))
    pay = {"id": ident, "order_id": F.col("l_orderkey"), "sku_id": F.col("l_partkey"), "payment_type": F.col("l_partkey") % 5, "callback_time": when, "total_amount": F.col("amount")}
    paid = envelope(lines, "refund_payment", "update", at, _map(**pay, refund_status=F.lit("1602")), _map(refund_status=F.lit("1601")))
    return asked.unionByName(done).unionByName(paid)


def cart_records(lines: DataFrame) -> DataFrame:
    """The lines of a detail id as the history of a cart row: one insert, then updates."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    last = F.lag(F.col("l_quantity").cast("int")).over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
    lines = lines.withColumn("last", last)
    data = _map(id=detail_id(), user_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), sku_num=F.col("l_quantity").cast("int"))
    kind = F.when(F.col("last").isNull(), "insert").otherwise("update")
    return envelope(lines, "cart_info", kind, F.col("l_shipdate"), data, F.when(F.col("last").isNotNull(), _map(sku_num=F.col("last"))))


def comment_records(conversations: DataFrame) -> DataFrame:
    """An insert for every turn of a conversation, appraised by its role, one second after the turn before."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn"))
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    data = _map(id=ident, user_id=F.col("conv_id"), sku_id=F.col("turn"), appraise=F.col("role"), comment_txt=F.col("text"))
    return envelope(conversations, "comment_info", "insert", at, data)


def payment_records(events: DataFrame) -> DataFrame:
    """Purchases as payments that were done, for the one order that a user has here; with event time."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 5
    data = _map(user_id=F.col("event_id"), order_id=F.col("user_id"), payment_type=k, callback_time=F.date_format("ts", STAMP), payment_status=F.lit("1602"))
    rows = envelope(events.where("event_type = 'purchase'"), "payment_info", "update", F.col("ts"), data, _map(payment_status=F.lit("1601")))
    return rows.withColumn("et", F.timestamp_seconds("ts"))


def clicked_details(events: DataFrame) -> DataFrame:
    """Clicks as order details of the one order that a user has here; with event time."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    return events.where("event_type = 'click'").select(
        text("event_id").alias("id"), text("user_id").alias("order_id"), F.get_json_object("props", "$.k").alias("sku_id"), none.alias("sku_name"), none.alias("province_id"),
        none.alias("activity_id"), none.alias("activity_rule_id"), none.alias("coupon_id"), F.lit("1").alias("sku_num"), none.alias("split_original_amount"),
        none.alias("split_activity_amount"), none.alias("split_coupon_amount"), F.floor("value").cast("string").alias("split_total_amount"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("et"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """One log record as JSON text an event: a page each, starts for signups, errors for errors, a display and k % 3 actions
    for what was seen and clicked. Every event whose id ends in 7 and is divisible by 3 is cut short."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = lambda c: F.col(c).cast("string")
    display = F.struct(text("event_id").alias("item"), F.lit("sku_id").alias("item_type"), (k % 10).cast("int").alias("pos_id"), F.lit(0).alias("pos_seq"))
    action = F.struct(F.col("event_type").alias("action_id"), text("event_id").alias("item"), F.lit("sku_id").alias("item_type"), (ms + 1).alias("ts"))
    record = F.struct(
        F.struct(F.concat(F.lit("m"), text("user_id")).alias("mid"), text("user_id").alias("uid"), F.when(F.col("event_type") == "signup", "1").otherwise("0").alias("is_new"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("vc")).alias("common"),
        F.struct(F.when(F.col("event_type") == "view", "home").otherwise(F.col("event_type")).alias("page_id"), F.when(k % 2 == 0, "search").alias("last_page_id"), F.floor("value").alias("during_time")).alias("page"),
        F.when(F.col("event_type").isin("view", "click"), F.array(display)).alias("displays"),
        F.when(F.col("event_type") == "click", F.array_repeat(action, (k % 3).cast("int"))).alias("actions"),
        F.when(F.col("event_type") == "signup", "icon").alias("start"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("code "), k.cast("string"))).alias("err"),
        ms.alias("ts"),
    )
    line = F.to_json(record)
    cut = (F.col("event_id") % 10 == 7) & (F.col("event_id") % 3 == 0)
    return events.select(F.when(cut, F.substring(line, 1, 20)).otherwise(line).alias("value"))
