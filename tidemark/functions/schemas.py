"""Record types of the inputs, in DDL: change records of the shop database, app logs, routing configuration."""

from __future__ import annotations

CDC = "database string, `table` string, type string, ts bigint, data map<string,string>, old map<string,string>"
_COMMON = "ar string, ba string, ch string, is_new string, md string, mid string, os string, sid string, uid string, vc string"
_PAGE = "page_id string, last_page_id string, item string, item_type string, during_time bigint"
_DISPLAY = "item string, item_type string, pos_id int, pos_seq int"
_ACTION = "action_id string, item string, item_type string, ts bigint"
LOG = (
    f"common struct<{_COMMON}>, page struct<{_PAGE}>, displays array<struct<{_DISPLAY}>>, actions array<struct<{_ACTION}>>, start string, err string, ts bigint"
)
PAGE_LOG = "common map<string,string>, page map<string,string>, ts bigint"
_DIM_ROUTE = "source_table string, sink_table string, sink_columns string, sink_family string, sink_row_key string"
_FACT_ROUTE = "source_table string, source_type string, sink_table string, sink_columns string"
DIM_CONFIG = f"op string, before struct<{_DIM_ROUTE}>, after struct<{_DIM_ROUTE}>, ts_ms bigint"
FACT_CONFIG = f"op string, before struct<{_FACT_ROUTE}>, after struct<{_FACT_ROUTE}>, ts_ms bigint"
_SPLIT = "sku_num string, split_original_amount string, split_activity_amount string, split_coupon_amount string"
ORDER_DETAIL = (
    "id string, order_id string, user_id string, sku_id string, sku_name string, province_id string, activity_id string, "
    f"activity_rule_id string, coupon_id string, date_id string, create_time string, {_SPLIT}, split_total_amount string, ts bigint"
)
CART_ADD = "id string, user_id string, sku_id string, sku_num int, ts bigint"
