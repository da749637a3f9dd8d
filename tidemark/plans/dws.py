"""Summary layer: batch forms of the windows. Columns are those of the summary records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.operators.joins import enrich, enrich_chain, keywords
from tidemark.operators.windows import DASHED, total, tumbling

Chain = Sequence[tuple[DataFrame, str, str, dict[str, str]]]


def keyword_counts(rows: DataFrame, text: str, ts: str, size: str = "5 seconds", splitter: Column | None = None) -> DataFrame:
    found = keywords(rows.where(F.col(text).isNotNull()), text, splitter)
    return tumbling(found, ts, size, [F.count(F.lit(1)).alias("keyword_count")], ["keyword"])


def search_rows(pages: DataFrame) -> DataFrame:
    """Page rows (columns of a page log) at which a keyword was searched for."""
    came = F.col("last_page_id").isin("search", "home") if "last_page_id" in pages.columns else F.lit(True)
    return pages.where(came & (F.col("item_type") == "keyword") & F.col("item").isNotNull())


def page_views(rows: DataFrame, visitor: str, ts: str, order: list[str], dims: Sequence[str] = ("vc", "ch", "ar", "is_new"), size: str = "5 seconds") -> DataFrame:
    """In batch the first rows of the visitors' days are added to the sums of all rows, so that no visitor's rows come together."""
    sums = [total("uv", "uv_ct"), total("sv", "sv_ct"), total("pv", "pv_ct"), total("dur", "dur_sum")]
    if rows.isStreaming:
        return tumbling(state.page_measures(rows, visitor, ts, order), ts, size, sums, dims, DASHED)
    needed = list(dict.fromkeys([visitor, ts, *order, *dims]))
    firsts = state.first_of_day(rows.select(*needed), [visitor], ts, order).select(ts, *dims, F.lit(1).alias("uv"), *[F.lit(0).cast("long").alias(m) for m in ("sv", "pv", "dur")])
    every = rows.select(ts, *dims, F.lit(0).alias("uv"), *state.view_measures())
    return tumbling(every.unionByName(firsts), ts, size, sums, dims, DASHED)


def home_detail_visitors(rows: DataFrame, visitor: str, ts: str, order: list[str], size: str = "10 seconds") -> DataFrame:
    rows, order = state.times(rows, [visitor, "page_id"], ts, order)
    firsts = state.home_and_detail(rows, visitor, ts, order)
    return tumbling(firsts, ts, size, [total("home_uv", "home_uv_ct"), total("good_detail_uv", "good_detail_uv_ct")], day=DASHED)


def logins(rows: DataFrame, user: str, ts: str, order: list[str], size: str = "10 seconds", history: DataFrame | None = None) -> DataFrame:
    """history: rows from before a stream, as in the two functions below."""
    past, _ = state.times(state.login_rows(history, user) if history is not None else None, [user], ts, order)
    rows, order = state.times(state.login_rows(rows, user), [user], ts, order)
    firsts = state.returning(rows, user, ts, order, history=past)
    return tumbling(firsts, ts, size, [total("back", "back_ct"), total("uu", "uu_ct")])


def registrations(rows: DataFrame, ts: str, size: str = "10 seconds") -> DataFrame:
    return tumbling(rows, ts, size, [F.count(F.lit(1)).alias("register_ct")], day_of="end")


def cart_users(rows: DataFrame, user: str, ts: str, order: list[str], size: str = "10 seconds") -> DataFrame:
    rows, order = state.times(rows, [user], ts, order)
    firsts = state.first_of_day(rows, [user], ts, order, expires=True)
    return tumbling(firsts, ts, size, [F.count(F.lit(1)).alias("cart_add_uu_ct")])


def paying_users(rows: DataFrame, user: str, ts: str, order: list[str], size: str = "10 seconds", history: DataFrame | None = None) -> DataFrame:
    (rows, _), (history, order) = state.times(rows, [user], ts, order), state.times(history, [user], ts, order)
    firsts = state.unique_and_new(rows, user, ts, order, history)
    return tumbling(firsts, ts, size, [total("uu", "payment_suc_unique_user_count"), total("new", "payment_suc_new_user_count")])


def ordering_users(rows: DataFrame, user: str, ts: str, order: list[str], size: str = "10 seconds", history: DataFrame | None = None) -> DataFrame:
    (rows, _), (history, order) = state.times(rows, [user], ts, order), state.times(history, [user], ts, order)
    firsts = state.unique_and_new(rows, user, ts, order, history)
    return tumbling(firsts, ts, size, [total("uu", "order_unique_user_count"), total("new", "order_new_user_count")])


def province_sums(rows: DataFrame, detail: list[str], ts: str, order: list[str], size: str = "10 seconds", max_gap: int | None = None) -> DataFrame:
    """rows: province_id, order_id, split_total_amount (decimal). Orders are counted once, repeated details summed once (within
    max_gap seconds, if given)."""
    once = state.deltas(rows, detail, ["split_total_amount"], order, ts, max_gap)
    return tumbling(once, ts, size, [total("split_total_amount", "order_amount", "decimal(38,2)")], ["province_id"], DASHED, distinct={"order_count": "order_id"})


def province_orders(rows: DataFrame, detail: list[str], ts: str, order: list[str], provinces: DataFrame, province_key: str, name: str, size: str = "10 seconds") -> DataFrame:
    """province_sums() with the names of the provinces."""
    return enrich(province_sums(rows, detail, ts, order, size), provinces, "province_id", province_key, {name: "province_name"})


SKU_MEASURES = {"original_amount": "split_original_amount", "activity_reduce_amount": "split_activity_amount", "coupon_reduce_amount": "split_coupon_amount", "order_amount": "split_total_amount"}


def sku_sums(rows: DataFrame, detail: list[str], ts: str, order: list[str], keys: Sequence[str] = ("sku_id",), size: str = "10 seconds", max_gap: int | None = None) -> DataFrame:
    """rows: the keys and the four split amounts (decimals)."""
    once = state.deltas(rows, detail, list(SKU_MEASURES.values()), order, ts, max_gap)
    return tumbling(once, ts, size, [total(c, n, "decimal(38,2)") for n, c in SKU_MEASURES.items()], keys, DASHED)


def sku_orders(rows: DataFrame, detail: list[str], ts: str, order: list[str], chain: Chain, keys: Sequence[str] = ("sku_id",), size: str = "10 seconds") -> DataFrame:
    """sku_sums(), then names: fewer rows meet the dimensions."""
    return enrich_chain(sku_sums(rows, detail, ts, order, keys, size), chain)


def refunds_by_brand(rows: DataFrame, ts: str, sku_chain: Chain, keys: Sequence[str], name_chain: Chain = (), size: str = "10 seconds") -> DataFrame:
    """rows: order_id, user_id and the sku; its brand and category come before the window, their names after it."""
    keyed = enrich_chain(rows, sku_chain)
    return enrich_chain(tumbling(keyed, ts, size, [], keys, DASHED, distinct={"refund_count": "order_id"}), name_chain)


def refunded_orders(rows: DataFrame, ts: str, size: str = "10 seconds") -> DataFrame:
    """The different orders, skus and users of each window: what a stream keeps, as brands may change meanwhile."""
    return tumbling(rows, ts, size, [F.count(F.lit(1)).alias("times")], ["order_id", "user_id", "sku_id"], DASHED)


def brands_of_refunds(windows: DataFrame, sku_chain: Chain, keys: Sequence[str], name_chain: Chain = ()) -> DataFrame:
    """refunds_by_brand() from whole windows of refunded_orders()."""
    keyed = enrich_chain(windows, sku_chain)
    sums = keyed.groupBy("stt", "edt", "cur_date", *keys).agg(F.count_distinct("order_id").alias("refund_count"))
    return enrich_chain(sums, name_chain)
