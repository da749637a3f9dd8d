"""Detail layer: facts from change records and logs. All are functions of DataFrames, for batch and stream alike.

Streams bound the state of their joins: `within` (for example '30 seconds') requires that both sides carry et with a
watermark, and that the times of joined rows lie no further apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import amount, day_of, key
from tidemark.operators import logs
from tidemark.operators.cdc import added, became, changes, pick
from tidemark.operators.joins import fact_rows, interval_join, lookup
from tidemark.operators.state import repaired_visitors
from tidemark.streaming.state import corrected

_DETAIL = ["sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id"]
_SPLIT = ["sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount"]


def _join(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner", within: str | None = None) -> DataFrame:
    """Equi-join under the names of the left; with `within` also by time. Columns of the right come under their own names."""
    r = right.select(*[F.col(c).alias(f"_{c}") if c in (*on.values(), "et") else F.col(c) for c in right.columns])
    near = None
    for a, b in on.items():
        this = left[a] == r[f"_{b}"]
        near = this if near is None else near & this
    if within:
        gap = F.expr(f"interval {within}")
        near &= (r["_et"] >= left["et"] - gap) & (r["_et"] <= left["et"] + gap)
    return left.join(r, near, how).drop(*[c for c in r.columns if c.startswith("_")])


def _extra(topic: DataFrame) -> tuple[str, ...]:
    return ("ts", "et") if "et" in topic.columns else ("ts",)


#: By fact the columns that hold a code, each with the column for its name.
NAMES = {
    "comments": {"appraise": "appraise_name"},
    "payments": {"payment_type_code": "payment_type_name"},
    "refunds": {"refund_type_code": "refund_type_name", "refund_reason_type_code": "refund_reason_type_name"},
    "refunds_paid": {"payment_type_code": "payment_type_name"},
}


def _named(rows: DataFrame, dic: DataFrame, fact: str) -> DataFrame:
    for code, name in NAMES[fact].items():
        rows = lookup(rows, dic, code, name)
    return rows


def comment_rows(topic: DataFrame, database: str | None = None) -> DataFrame:
    return pick(changes(topic, "comment_info", "insert", database), "id", "user_id", "sku_id", "appraise", "comment_txt")


def comment_facts(named: DataFrame) -> DataFrame:
    return named.select("id", "user_id", "sku_id", "appraise", "appraise_name", "comment_txt", "ts")


def comments(topic: DataFrame, dic: DataFrame, database: str | None = None) -> DataFrame:
    return comment_facts(_named(comment_rows(topic, database), dic, "comments"))


def cart_adds(topic: DataFrame, database: str | None = None) -> DataFrame:
    rows = changes(topic, "cart_info", None, database).withColumn("sku_num", added("sku_num")).where("sku_num is not null")
    return rows.select(key("data", "id").alias("id"), key("data", "user_id").alias("user_id"), key("data", "sku_id").alias("sku_id"), "sku_num", "ts")


def _detail_parts(topic: DataFrame, database: str | None, extra: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    detail = pick(
        changes(topic, "order_detail", "insert", database), "id", "order_id", "sku_id", "sku_name", "create_time", "sku_num", "order_price",
        "split_total_amount", "split_activity_amount", "split_coupon_amount", extra=extra,
    ).withColumn("split_original_amount", amount("sku_num", "order_price"))
    side = extra[1:]
    order = pick(changes(topic, "order_info", "insert", database), "id as oid", "user_id", "province_id", extra=side)
    activity = pick(changes(topic, "order_detail_activity", "insert", database), "order_detail_id", "activity_id", "activity_rule_id", extra=side)
    coupon = pick(changes(topic, "order_detail_coupon", "insert", database), "order_detail_id", "coupon_id", extra=side)
    return detail, order, activity, coupon


def _detail_facts(rows: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("date_id", day_of("create_time")).select(
        "id", "order_id", "user_id", *_DETAIL, "date_id", "create_time", *_SPLIT, "split_total_amount", *extra
    )


def order_details(topic: DataFrame, database: str | None = None, within: str | None = None) -> DataFrame:
    """Order details with their order, and with activity and coupon where there are any. On streams a row waits for both until
    `within` has passed; see corrected_order_details()."""
    extra = _extra(topic) if within else ("ts",)
    detail, order, activity, coupon = _detail_parts(topic, database, extra)
    if within:
        detail = _join(detail, order, {"order_id": "oid"}, within=within)
    rows = _join(detail, activity, {"id": "order_detail_id"}, "left", within)
    rows = _join(rows, coupon, {"id": "order_detail_id"}, "left", within)
    if not within:  # last, so that rows lie by their order when what follows joins on it too
        rows = _join(rows, order, {"order_id": "oid"})
    return _detail_facts(rows, extra)


def corrected_order_details(topic: DataFrame, within: int, database: str | None = None) -> DataFrame:
    """Order details of a stream as soon as their order is there, and again, under the next `version`, when their activity or
    coupon comes, at most `within` seconds apart. The last version of each id is its row of order_details()."""
    detail, order, activity, coupon = _detail_parts(topic, database, ("ts", "et"))
    rows = _join(detail, order, {"order_id": "oid"}, within=f"{within} seconds")
    sides = {n: side.withColumnRenamed("order_detail_id", "id") for n, side in (("activity", activity), ("coupon", coupon))}
    return _detail_facts(corrected(rows, sides, "id", "et", within), ("ts", "et", "version"))


def order_cancels(topic: DataFrame, details: DataFrame, database: str | None = None, within: str | None = None) -> DataFrame:
    """Details of orders that went from placed to cancelled."""
    rows = changes(topic, "order_info", "update", database).where(became("order_status", "1003", "1001"))
    extra = ("et",) if within else ()
    cancel = pick(rows, "id as oid", "operate_time as cancel_time", extra=("ts", *extra)).withColumnRenamed("ts", "cancel_ts")
    keep = details.drop("ts", "date_id", "create_time")
    rows = _join(keep, cancel, {"order_id": "oid"}, within=within).withColumn("date_id", day_of("cancel_time"))
    return rows.select("id", "order_id", "user_id", *_DETAIL, "date_id", "cancel_time", *_SPLIT, "split_total_amount", F.col("cancel_ts").alias("ts"), *extra)


def payment_rows(topic: DataFrame, details: DataFrame, database: str | None = None, before: str = "30 minutes", after: str = "5 seconds") -> DataFrame:
    rows = changes(topic, "payment_info", "update", database).where(became("payment_status", "1602"))
    paid = pick(rows, "user_id as payer", "order_id", "payment_type as payment_type_code", "callback_time", extra=("ts", "et"))
    both = interval_join(details, paid, ["order_id"], "et", "et", before, after)
    return both.select("l.id", "l.order_id", "r.payer", *[f"l.{c}" for c in (*_DETAIL, *_SPLIT, "split_total_amount")], "r.payment_type_code", "r.callback_time", "r.ts", "r.et")


def payment_facts(named: DataFrame) -> DataFrame:
    return named.select(
        F.col("id").alias("order_detail_id"), "order_id", F.col("payer").alias("user_id"), *_DETAIL, "payment_type_code", "payment_type_name", "callback_time",
        *_SPLIT, F.col("split_total_amount").alias("split_payment_amount"), "ts", "et",
    )


def payments(topic: DataFrame, details: DataFrame, dic: DataFrame, database: str | None = None, before: str = "30 minutes", after: str = "5 seconds") -> DataFrame:
    """Paid order details: the detail was made at most 30 minutes before and 5 seconds after its payment. Both need et."""
    return payment_facts(_named(payment_rows(topic, details, database, before, after), dic, "payments"))


def _refund_orders(topic: DataFrame, status: str, database: str | None, within: str | None) -> DataFrame:
    rows = changes(topic, "order_info", "update", database).where(became("order_status", status))
    return pick(rows, "id as oid", "user_id", "province_id", extra=("et",) if within else ())


def refund_rows(topic: DataFrame, database: str | None = None, within: str | None = None) -> DataFrame:
    extra = ("ts", "et") if within else ("ts",)
    asked = pick(
        changes(topic, "order_refund_info", "insert", database), "id", "user_id", "order_id", "sku_id", "refund_type as refund_type_code", "refund_num", "refund_amount",
        "refund_reason_type as refund_reason_type_code", "refund_reason_txt", "create_time", extra=extra,
    )
    return _join(asked, _refund_orders(topic, "1005", database, within).drop("user_id"), {"order_id": "oid"}, within=within)


def refund_facts(named: DataFrame) -> DataFrame:
    extra = _extra(named)
    return named.select(
        "id", "user_id", "order_id", "sku_id", "province_id", day_of("create_time").alias("date_id"), "create_time", "refund_type_code", "refund_type_name",
        "refund_reason_type_code", "refund_reason_type_name", "refund_reason_txt", "refund_num", "refund_amount", *extra,
    )


def refunds(topic: DataFrame, dic: DataFrame, database: str | None = None, within: str | None = None) -> DataFrame:
    """Refund requests with the province of their order and the names of their type and reason."""
    return refund_facts(_named(refund_rows(topic, database, within), dic, "refunds"))


def refund_paid_rows(topic: DataFrame, database: str | None = None, within: str | None = None) -> DataFrame:
    extra = ("ts", "et") if within else ("ts",)
    rows = changes(topic, "refund_payment", "update").where(became("refund_status", "1602"))
    paid = pick(rows, "id", "order_id", "sku_id", "payment_type as payment_type_code", "callback_time", "total_amount as refund_amount", extra=extra)
    asked = changes(topic, "order_refund_info", "update").where(became("refund_status", "0705"))
    asked = pick(asked, "order_id as ooid", "sku_id as osku", "refund_num", extra=extra[1:])
    rows = _join(paid, asked, {"order_id": "ooid", "sku_id": "osku"}, within=within)
    return _join(rows, _refund_orders(topic, "1006", database, within), {"order_id": "oid"}, within=within)


def refund_paid_facts(named: DataFrame) -> DataFrame:
    return named.select(
        "id", "user_id", "order_id", "sku_id", "province_id", "payment_type_code", "payment_type_name", day_of("callback_time").alias("date_id"), "callback_time",
        "refund_num", "refund_amount", *_extra(named),
    )


def refunds_paid(topic: DataFrame, dic: DataFrame, database: str | None = None, within: str | None = None) -> DataFrame:
    """Paid refunds with their request (same order and sku), order and payment type. Only the order's records are held
    to the database, as not all sources of the others name theirs."""
    return refund_paid_facts(_named(refund_paid_rows(topic, database, within), dic, "refunds_paid"))


def routed_facts(topic: DataFrame, config: DataFrame, preloaded: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """topic, value: each configured record's data as JSON for the topic that its configuration names."""
    rows = fact_rows(topic, config, preloaded, order)
    return rows.select(F.col("sink_table").alias("topic"), F.to_json("data").alias("value"))


#: What the repair of flags needs of a log record.
_FLAG = "common struct<mid string, is_new string>, ts bigint"


def repaired_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log records with the flag of new visitors put right, dirty lines). Records of one time follow a hash of their text,
    which does not travel itself. No stream of records is held back, late ones pass too."""

    def flagged(log: DataFrame) -> DataFrame:
        return log.withColumns({"mid": F.col("common.mid"), "is_new": F.col("common.is_new"), "at": F.timestamp_millis("ts"), "no": F.xxhash64("raw")}).drop("raw")

    log, dirty = logs.parsed(lines)
    seen = None if lines.isStreaming else flagged(logs.parsed(lines, schema=_FLAG)[0])
    log = repaired_visitors(flagged(log), "mid", "at", "is_new", ["at", "no"], timed=False, seen=seen)
    return log.withColumn("common", F.col("common").withField("is_new", F.col("is_new"))).drop("mid", "is_new", "at", "no"), dirty


def split_log(lines: DataFrame) -> dict[str, DataFrame]:
    """The log's outputs by name, and `dirty` lines."""
    log, dirty = repaired_log(lines)
    return logs.split(log) | {"dirty": dirty}
