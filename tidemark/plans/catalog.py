"""Every batch query by name, over the star tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_json, event_time, ms_to_text, seconds_to_ms, text_to_ms, words
from tidemark.functions.segment import segmenter
from tidemark.operators.cdc import fold, latest
from tidemark.operators.joins import interval_join, lookup
from tidemark.operators.logs import json_lines
from tidemark.operators.state import repaired_visitors
from tidemark.plans import dim, dwd, dws, envelopes
from tidemark.plans.oracle import ORACLE
from tidemark.sources.readers import dictionary

__all__ = ["ORACLE", "QUERIES"]

LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def events_of(self, *kinds: str) -> DataFrame:
        return self.events.where(F.col("event_type").isin(*kinds))

    def codes(self) -> DataFrame:
        return dictionary(self.region, "r_regionkey", "r_name")


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


def _money(c: str):
    return F.col(c).cast("decimal(16,2)")


@query
def order_users_window(t: Tables) -> DataFrame:
    return dws.ordering_users(t.orders, "o_custkey", "o_orderdate", ["o_orderdate", "o_orderkey"], "1 day")


@query
def cart_unique_users_window(t: Tables) -> DataFrame:
    return dws.cart_users(t.events_of("click"), "user_id", "ts", ["ts", "event_id"])


@query
def pay_users_window(t: Tables) -> DataFrame:
    return dws.paying_users(t.events_of("purchase"), "user_id", "ts", ["ts", "event_id"])


@query
def user_login_return(t: Tables) -> DataFrame:
    last = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return dws.logins(t.events.withColumn("last_page_id", last), "user_id", "ts", ["ts", "event_id"])


@query
def user_register_window(t: Tables) -> DataFrame:
    return dws.registrations(t.events_of("signup"), "ts")


@query
def home_detail_uv_window(t: Tables) -> DataFrame:
    page = F.when(F.col("event_type") == "view", "home").when(F.col("event_type") == "click", "good_detail").otherwise(F.col("event_type"))
    return dws.home_detail_visitors(t.events.withColumn("page_id", page), "user_id", "ts", ["ts", "event_id"])


@query
def page_view_by_dims(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select(
        "user_id", "ts", "event_id", F.concat(F.lit("v"), (k % 3).cast("string")).alias("vc"), F.col("event_type").alias("ch"), (k % 7).cast("string").alias("ar"),
        F.when(F.col("event_type") == "signup", "1").otherwise("0").alias("is_new"), F.when(k % 2 == 0, "home").alias("last_page_id"), F.floor("value").alias("during_time"),
    )
    return dws.page_views(rows, "user_id", "ts", ["ts", "event_id"])


@query
def new_visitor_repair(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type").isin("signup", "click"), "1").otherwise("0").alias("is_new"))
    return repaired_visitors(rows, "user_id", "ts", "is_new", ["ts", "event_id"])


@query
def keyword_counts(t: Tables) -> DataFrame:
    rows = t.documents.select("text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("at"))
    return dws.keyword_counts(rows, "text", "at")


@query
def sku_orders_chain(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", *LINE, F.col("l_partkey").alias("sku_id"), F.col("l_suppkey").alias("seller_id"), (F.col("l_quantity").cast("decimal(16,2)")).alias("split_original_amount"),
        _money("l_discount").alias("split_activity_amount"), _money("l_tax").alias("split_coupon_amount"), _money("l_extendedprice").alias("split_total_amount"),
    )
    chain = [
        (t.part, "sku_id", "p_partkey", {"p_name": "sku_name", "p_brand": "trademark_name", "p_type": "category3_name"}),
        (t.supplier, "seller_id", "s_suppkey", {"s_name": "seller_name", "s_nationkey": "category2_id"}),
        (t.nation, "category2_id", "n_nationkey", {"n_name": "category2_name", "n_regionkey": "category1_id"}),
        (t.region, "category1_id", "r_regionkey", {"r_name": "category1_name"}),
    ]
    return dws.sku_orders(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", LINE, chain, ["sku_id", "seller_id"], "1 day")


@query
def province_orders(t: Tables) -> DataFrame:
    users = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("province_id"))
    rows = t.lineitem.join(users, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumns({"split_total_amount": _money("l_extendedprice"), "order_id": F.col("l_orderkey")})
    return dws.province_orders(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", LINE, t.nation, "n_nationkey", "n_name", "1 day")


@query
def refund_by_brand_user(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("sku_id"), "l_shipdate")
    chain = [(t.part, "sku_id", "p_partkey", {"p_brand": "trademark_id", "p_type": "category3_id"})]
    return dws.refunds_by_brand(rows, "l_shipdate", chain, ["trademark_id", "category3_id", "user_id"], size="1 day")


def _details(t: Tables) -> DataFrame:
    topic = envelopes.order_records(t.orders).unionByName(envelopes.detail_records(t.lineitem))
    return dwd.order_details(topic, envelopes.DATABASE)


@query
def order_detail_wide(t: Tables) -> DataFrame:
    return _details(t)


@query
def order_cancel_detail(t: Tables) -> DataFrame:
    return dwd.order_cancels(envelopes.order_records(t.orders), _details(t), envelopes.DATABASE)


@query
def payment_interval_join(t: Tables) -> DataFrame:
    made = t.events_of("click").select("user_id", F.col("event_id").alias("order_detail_id"), "ts")
    code = (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")
    paid = t.events_of("purchase").select("user_id", F.col("event_id").alias("payment_id"), "ts", code.alias("payment_type_code"))
    both = interval_join(made, paid, ["user_id"], "ts", "ts", "30 minutes", "5 seconds")
    rows = both.select("l.order_detail_id", "r.payment_id", "l.user_id", "r.payment_type_code")
    return lookup(rows, t.codes(), "payment_type_code", "payment_type_name").select("order_detail_id", "payment_id", "user_id", "payment_type_code", "payment_type_name")


def _refund_topic(t: Tables) -> DataFrame:
    return envelopes.order_records(t.orders).unionByName(envelopes.refund_records(t.lineitem, t.orders))


@query
def refund_detail(t: Tables) -> DataFrame:
    return dwd.refunds(_refund_topic(t), t.codes(), envelopes.DATABASE)


@query
def refund_paid_detail(t: Tables) -> DataFrame:
    return dwd.refunds_paid(_refund_topic(t), t.codes(), envelopes.DATABASE)


@query
def cart_add_delta(t: Tables) -> DataFrame:
    return dwd.cart_adds(envelopes.cart_records(t.lineitem))


@query
def comment_dim_lookup(t: Tables) -> DataFrame:
    dic = dictionary(t.conversations.select("role").distinct(), "role", F.upper("role"))
    rows = t.conversations.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"))
    return lookup(rows, dic, "role", "role_name").select("conv_id", "turn", "role", "role_name", "n_chars")


@query
def comment_detail(t: Tables) -> DataFrame:
    dic = dictionary(t.conversations.select("role").distinct(), "role", F.upper("role"))
    return dwd.comments(envelopes.comment_records(t.conversations), dic, envelopes.DATABASE)


@query
def payment_detail(t: Tables) -> DataFrame:
    rows = dwd.payments(envelopes.payment_records(t.events), envelopes.clicked_details(t.events), t.codes(), envelopes.DATABASE)
    return rows.select("order_detail_id", "order_id", "user_id", "sku_id", "payment_type_code", "payment_type_name", "callback_time", "sku_num", "split_payment_amount", "ts")


@query
def search_keywords(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    came = F.when(k % 3 == 0, "search").when(k % 3 == 1, "home").otherwise("cart")
    item = F.concat_ws(" ", F.lit("No"), F.col("event_type"), (k % 4).cast("string"))
    rows = t.events.select("ts", came.alias("last_page_id"), F.when(F.col("event_type") != "error", "keyword").alias("item_type"), F.when(k % 5 != 0, item).alias("item"))
    return dws.keyword_counts(dws.search_rows(rows), "item", "ts")


@query
def keyword_pieces(t: Tables) -> DataFrame:
    """Words as if written without spaces between their pieces: the dictionary is the short words of the benchmark."""
    short = t.benchmark.select(F.explode(words("text")).alias("word")).where("char_length(word) between 2 and 4").distinct()
    rows = t.conversations.select("text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("at"))
    split = segmenter(rows.sparkSession, short, unspaced=r"\p{L}\p{M}")
    return dws.keyword_counts(rows, "text", "at", "1 hour", split("text"))


@query
def latest_lines(t: Tables) -> DataFrame:
    return latest(t.lineitem, ["l_orderkey", "l_linenumber"], LINE)


@query
def times_as_text(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", ms.alias("ms"), F.floor(ms / 1000).alias("s"))
    text = ms_to_text("ms")
    return rows.select(
        "event_id", text.alias("at"), F.unix_millis(event_time("ms")).alias("from_ms"), F.unix_seconds(event_time("s", 0)).alias("from_s"), seconds_to_ms("s").alias("whole_ms"),
        text_to_ms(text).alias("east_ms"), text_to_ms(F.substring(text, 1, 10), "+00:00").alias("day_ms"),
    )


def _log(t: Tables, name: str) -> DataFrame:
    return dwd.split_log(envelopes.log_lines(t.events))[name]


@query
def log_split_pages(t: Tables) -> DataFrame:
    return _log(t, "page").select("mid", "uid", "is_new", "vc", "page_id", "last_page_id", "during_time", "ts")


@query
def log_split_starts(t: Tables) -> DataFrame:
    return _log(t, "start").select("mid", "uid", "is_new", "start", "ts")


@query
def log_split_displays(t: Tables) -> DataFrame:
    return _log(t, "display").select("mid", "item", "item_type", "pos_id", "pos_seq", "ts")


@query
def log_split_actions(t: Tables) -> DataFrame:
    return _log(t, "action").select("mid", "action_id", "item", "item_type", "ts")


@query
def log_split_errors(t: Tables) -> DataFrame:
    return _log(t, "err").select("mid", "err", "ts")


@query
def log_split_dirty(t: Tables) -> DataFrame:
    return _log(t, "dirty")


def _routes(t: Tables, kind: str) -> DataFrame:
    """Configuration changes: those of regions name tables, later ones delete or alter earlier ones."""
    c = F.col
    order = t.region.select(c("r_regionkey").alias("at"), (c("r_regionkey") % 4).alias("i"))
    table = F.when(c("i") == 0, "order_info").when(c("i") == 1, "order_detail").when(c("i") == 2, "order_detail_coupon").otherwise("none")
    op = F.when(c("at") == 2, "d").otherwise("u")
    sink = F.concat_ws("_", F.lit(kind), table, c("at").cast("string"))
    rows = order.select(op.alias("op"), table.alias("source_table"), sink.alias("sink_table"), F.lit("id,order_id").alias("sink_columns"), "at")
    if kind == "dwd":
        return rows.withColumn("source_type", F.lit("insert"))
    return rows.withColumns({"sink_family": F.lit("info"), "sink_row_key": F.lit("id")})


@query
def fact_route(t: Tables) -> DataFrame:
    topic = envelopes.order_records(t.orders).unionByName(envelopes.detail_records(t.lineitem))
    rows = dwd.fact_rows(topic, _routes(t, "dwd"), order="at")
    return rows.select("sink_table", F.col("data")["id"].alias("id"), F.col("data")["order_id"].alias("order_id"), "ts")


@query
def dim_filter(t: Tables) -> DataFrame:
    topic = envelopes.order_records(t.orders).unionByName(envelopes.detail_records(t.lineitem))
    rows = dim.dim_changes(topic, _routes(t, "dim"), "at", project=True)
    return rows.select("sink_table", "row_key", "type", F.col("data")["order_id"].alias("order_id"), "ts")


@query
def dim_upsert(t: Tables) -> DataFrame:
    keep = lambda kind, c: F.when(F.col("event_type") == kind, c)
    rows = t.events.select("user_id", "ts", "event_id", "event_type", keep("click", F.col("event_id")).alias("last_click"), keep("view", F.col("props")).alias("last_view"))
    return fold(rows, ["user_id"], ["ts", "event_id"], ["last_click", "last_view"], F.col("event_type") == "error")


@query
def json_output(t: Tables) -> DataFrame:
    rows = order_users_window(t)
    return rows.select("stt", as_json("stt", "edt", "cur_date", "order_unique_user_count", "order_new_user_count").alias("line"))


@query
def keyed_facts_as_json(t: Tables) -> DataFrame:
    return json_lines(cart_add_delta(t).select("id", "sku_num"))
