"""DuckDB SQL for the batch queries."""

from __future__ import annotations


def _window(ts: str, seconds: int, day: str = "%Y%m%d", day_of: str = "start") -> str:
    us = seconds * 1_000_000
    start = f"make_timestamp(epoch_us({ts}) // {us} * {us})"
    end = f"make_timestamp(epoch_us({ts}) // {us} * {us} + {us})"
    text = "'%Y-%m-%d %H:%M:%S'"
    return f"strftime({start}, {text}) as stt, strftime({end}, {text}) as edt, strftime({start if day_of == 'start' else end}, '{day}') as cur_date"


def _firsts(table: str, user: str, ts: str, tie: str, where: str = "true", more: str = "") -> str:
    """Rows e with last_day, of which the first of each day are those where it differs."""
    by = f"partition by {user}{more} order by {ts}, {tie}"
    return f"e as (select *, lag(cast({ts} as date)) over ({by}) as last_day from {table} where {where}), f as (select * from e where last_day is distinct from cast({ts} as date))"


_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_BACK = f"partition by l_orderkey, l_linenumber order by {_LINE}"
#: What stands between keywords.
_GAP = r"[^\p{L}\p{M}\p{N}_]+"
_K = "cast(json_extract_string(props, '$.k') as bigint)"
_FIRST_LINE = "line as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as nth from lineitem) where nth = 1)"
_DETAIL_COLUMNS = """
    cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as id, cast(l_orderkey as varchar) as order_id, cast(o_custkey as varchar) as user_id,
    cast(l_partkey as varchar) as sku_id, 'sku ' || cast(l_partkey as varchar) as sku_name, cast(o_custkey % 25 as varchar) as province_id,
    case when l_discount > 0.05 then cast(l_linenumber as varchar) end as activity_id, case when l_discount > 0.05 then cast(l_suppkey as varchar) end as activity_rule_id,
    case when l_tax > 0.05 then cast(l_suppkey as varchar) end as coupon_id"""
_AMOUNTS = """
    cast(cast(l_quantity as integer) as varchar) as sku_num,
    cast(cast(cast(l_quantity as integer) as decimal(16,2)) * cast(l_extendedprice as decimal(16,2)) as varchar) as split_original_amount,
    cast(cast(l_discount as decimal(16,2)) as varchar) as split_activity_amount, cast(cast(l_tax as decimal(16,2)) as varchar) as split_coupon_amount,
    cast(cast(l_extendedprice as decimal(16,2)) as varchar) as split_total_amount"""
_REFUND = """r as (
    select l_orderkey, l_partkey, cast(sum(l_quantity) as integer) as n, sum(cast(l_extendedprice as decimal(16,2))) as amount, max(l_shipdate) as t
    from lineitem where l_returnflag = 'R' group by all)"""
_LOG = f"""g as (select *, {_K} as k, epoch_us(ts) // 1000 as ms, case when event_type = 'signup' then '1' else '0' end as flag from events where not (event_id % 10 = 7 and event_id % 3 = 0)),
    raw as (select *, lag(0) over w as none, first_value(flag) over w as flag1, cast(first_value(ts) over w as date) as day1 from g window w as (partition by user_id order by ms, event_id)),
    log as (select *, case when flag = '1' and day1 - case when flag1 = '1' then 0 else 1 end < cast(ts as date) then '0' else flag end as is_new from raw)"""
_TOPIC_COUNTS = _FIRST_LINE + """,
    records as (
        select 'order_info' as tab, 'insert' as type, cast(o_orderkey as varchar) as id, null as order_id, epoch(o_orderdate) as ts from orders
        union all select 'order_info', 'update', cast(o_orderkey as varchar), null, epoch(o_orderdate) from orders
        union all select 'order_detail', 'insert', cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar), cast(l_orderkey as varchar), epoch(l_shipdate) from line
        union all select 'order_detail_coupon', 'insert', null, null, epoch(l_shipdate) from line where l_tax > 0.05
    ),
    c as (select r_regionkey as n, case r_regionkey % 4 when 0 then 'order_info' when 1 then 'order_detail' when 2 then 'order_detail_coupon' else 'none' end as tab from region),
    active as (select tab, max(n) as n from c group by tab having max(n) <> 2)"""

ORACLE: dict[str, str] = {
    "order_users_window": f"with {_firsts('orders', 'o_custkey', 'o_orderdate', 'o_orderkey')} select {_window('o_orderdate', 86400)}, count(*) as order_unique_user_count, count(*) filter (last_day is null) as order_new_user_count from f group by all",
    "cart_unique_users_window": f"with {_firsts('events', 'user_id', 'ts', 'event_id', 'event_type = $$click$$')} select {_window('ts', 10)}, count(*) as cart_add_uu_ct from f group by all",
    "pay_users_window": f"with {_firsts('events', 'user_id', 'ts', 'event_id', 'event_type = $$purchase$$')} select {_window('ts', 10)}, count(*) as payment_suc_unique_user_count, count(*) filter (last_day is null) as payment_suc_new_user_count from f group by all",
    "user_login_return": f"with {_firsts('events', 'user_id', 'ts', 'event_id', 'user_id is not null and event_type in ($$signup$$, $$view$$)')} select {_window('ts', 10)}, count(*) filter (last_day is not null and epoch_us(ts) - epoch_us(cast(last_day as timestamp)) >= 8 * 86400000000) as back_ct, count(*) as uu_ct from f group by all",
    "user_register_window": f"select {_window('ts', 10, day_of='end')}, count(*) as register_ct from events where event_type = 'signup' group by all",
    "home_detail_uv_window": f"with {_firsts('events', 'user_id', 'ts', 'event_id', 'event_type in ($$view$$, $$click$$)', ', event_type')} select {_window('ts', 10, '%Y-%m-%d')}, count(*) filter (event_type = 'view') as home_uv_ct, count(*) filter (event_type = 'click') as good_detail_uv_ct from f group by all",
    "page_view_by_dims": f"""with e as (select *, {_K} as k, lag(cast(ts as date)) over (partition by user_id order by ts, event_id) as last_day from events)
        select {_window('ts', 5, '%Y-%m-%d')}, 'v' || cast(k % 3 as varchar) as vc, event_type as ch, cast(k % 7 as varchar) as ar, case when event_type = 'signup' then '1' else '0' end as is_new,
        count(*) filter (last_day is distinct from cast(ts as date)) as uv_ct, count(*) filter (coalesce(k % 2 <> 0, true)) as sv_ct, count(*) as pv_ct, cast(sum(coalesce(cast(floor(value) as bigint), 0)) as bigint) as dur_sum from e group by all""",
    "new_visitor_repair": """with e as (select event_id, user_id, ts, case when event_type in ('signup', 'click') then '1' else '0' end as f from events),
        g as (select *, first_value(f) over w as f1, cast(first_value(ts) over w as date) as d1 from e window w as (partition by user_id order by ts, event_id))
        select event_id, user_id, ts, case when f = '1' and d1 - case when f1 = '1' then 0 else 1 end < cast(ts as date) then '0' else f end as is_new from g""",
    "keyword_counts": f"""with d as (select make_timestamp((1700000000 + doc_id) * 1000000) as ts, unnest(regexp_split_to_array(lower(text), '{_GAP}')) as keyword from documents)
        select {_window('ts', 5)}, keyword, count(*) as keyword_count from d where keyword <> '' group by all""",
    "sku_orders_chain": f"""with d as (select l_shipdate, l_partkey, l_suppkey,
            cast(l_quantity as decimal(16,2)) - coalesce(lag(cast(l_quantity as decimal(16,2))) over w, 0) as a, cast(l_discount as decimal(16,2)) - coalesce(lag(cast(l_discount as decimal(16,2))) over w, 0) as b,
            cast(l_tax as decimal(16,2)) - coalesce(lag(cast(l_tax as decimal(16,2))) over w, 0) as c, cast(l_extendedprice as decimal(16,2)) - coalesce(lag(cast(l_extendedprice as decimal(16,2))) over w, 0) as d
            from lineitem window w as ({_BACK})),
        s as (select {_window('l_shipdate', 86400, '%Y-%m-%d')}, l_partkey as sku_id, l_suppkey as seller_id, cast(sum(a) as decimal(38,2)) as original_amount, cast(sum(b) as decimal(38,2)) as activity_reduce_amount,
            cast(sum(c) as decimal(38,2)) as coupon_reduce_amount, cast(sum(d) as decimal(38,2)) as order_amount from d group by all)
        select s.*, p_name as sku_name, p_brand as trademark_name, p_type as category3_name, s_name as seller_name, s_nationkey as category2_id, n_name as category2_name, n_regionkey as category1_id, r_name as category1_name
        from s left join part on p_partkey = sku_id left join supplier on s_suppkey = seller_id left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey""",
    "province_orders": f"""with d as (select l_shipdate, l_orderkey, c_nationkey as province_id, cast(l_extendedprice as decimal(16,2)) - coalesce(lag(cast(l_extendedprice as decimal(16,2))) over ({_BACK}), 0) as v
            from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
        s as (select {_window('l_shipdate', 86400, '%Y-%m-%d')}, province_id, count(distinct l_orderkey) as order_count, cast(sum(v) as decimal(38,2)) as order_amount from d group by all)
        select s.*, n_name as province_name from s left join nation on n_nationkey = province_id""",
    "refund_by_brand_user": f"""select {_window('l_shipdate', 86400, '%Y-%m-%d')}, p_brand as trademark_id, p_type as category3_id, o_custkey as user_id, count(distinct l_orderkey) as refund_count
        from lineitem join orders on l_orderkey = o_orderkey left join part on p_partkey = l_partkey where l_returnflag = 'R' group by all""",
    "order_detail_wide": f"""with {_FIRST_LINE} select {_DETAIL_COLUMNS}, strftime(l_shipdate, '%Y-%m-%d') as date_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as create_time, {_AMOUNTS}, cast(epoch(l_shipdate) as bigint) as ts
        from line join orders on l_orderkey = o_orderkey""",
    "order_cancel_detail": f"""with {_FIRST_LINE} select {_DETAIL_COLUMNS}, strftime(o_orderdate, '%Y-%m-%d') as date_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as cancel_time, {_AMOUNTS}, cast(epoch(o_orderdate) as bigint) as ts
        from line join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'""",
    "payment_interval_join": f"""select a.event_id as order_detail_id, b.event_id as payment_id, a.user_id, cast(r_regionkey as varchar) as payment_type_code, r_name as payment_type_name
        from events a join events b on a.user_id = b.user_id and a.ts >= b.ts - interval 30 minute and a.ts <= b.ts + interval 5 second
        join region on r_regionkey = cast(json_extract_string(b.props, '$.k') as bigint) % 5 where a.event_type = 'click' and b.event_type = 'purchase'""",
    "refund_detail": f"""with {_REFUND} select cast(l_orderkey as varchar) || '-' || cast(l_partkey as varchar) as id, cast(o_custkey as varchar) as user_id, cast(l_orderkey as varchar) as order_id, cast(l_partkey as varchar) as sku_id,
        cast(o_custkey % 25 as varchar) as province_id, strftime(t, '%Y-%m-%d') as date_id, strftime(t, '%Y-%m-%d %H:%M:%S') as create_time, cast(a.r_regionkey as varchar) as refund_type_code, a.r_name as refund_type_name,
        cast(b.r_regionkey as varchar) as refund_reason_type_code, b.r_name as refund_reason_type_name, 'returned' as refund_reason_txt, cast(n as varchar) as refund_num, cast(amount as varchar) as refund_amount, cast(epoch(t) as bigint) as ts
        from r join orders on l_orderkey = o_orderkey join region a on a.r_regionkey = l_partkey % 5 join region b on b.r_regionkey = l_orderkey % 5 where o_orderstatus = 'P'""",
    "refund_paid_detail": f"""with {_REFUND} select cast(l_orderkey as varchar) || '-' || cast(l_partkey as varchar) as id, cast(o_custkey as varchar) as user_id, cast(l_orderkey as varchar) as order_id, cast(l_partkey as varchar) as sku_id,
        cast(o_custkey % 25 as varchar) as province_id, cast(r_regionkey as varchar) as payment_type_code, r_name as payment_type_name, strftime(t, '%Y-%m-%d') as date_id, strftime(t, '%Y-%m-%d %H:%M:%S') as callback_time,
        cast(n as varchar) as refund_num, cast(amount as varchar) as refund_amount, cast(epoch(t) as bigint) as ts
        from r join orders on l_orderkey = o_orderkey join region on r_regionkey = l_partkey % 5 where o_orderstatus not in ('F', 'P')""",
    "cart_add_delta": """with e as (select *, lag(cast(l_quantity as integer)) over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as q from lineitem)
        select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as id, cast(l_orderkey as varchar) as user_id, cast(l_partkey as varchar) as sku_id,
        cast(l_quantity as integer) - coalesce(q, 0) as sku_num, cast(epoch(l_shipdate) as bigint) as ts from e where q is null or cast(l_quantity as integer) > q""",
    "comment_dim_lookup": "select conv_id, turn, role, upper(role) as role_name, length(text) as n_chars from conversations where role is not null",
    "comment_detail": """select cast(conv_id as varchar) || '-' || cast(turn as varchar) as id, cast(conv_id as varchar) as user_id, cast(turn as varchar) as sku_id, role as appraise, upper(role) as appraise_name,
        text as comment_txt, 1700000000 + conv_id * 100 + turn as ts from conversations where role is not null""",
    "payment_detail": f"""select cast(a.event_id as varchar) as order_detail_id, cast(a.user_id as varchar) as order_id, cast(b.event_id as varchar) as user_id, json_extract_string(a.props, '$.k') as sku_id,
        cast(r_regionkey as varchar) as payment_type_code, r_name as payment_type_name, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as callback_time, '1' as sku_num, cast(cast(floor(a.value) as bigint) as varchar) as split_payment_amount,
        epoch_us(b.ts) // 1000000 as ts
        from events a join events b on a.user_id = b.user_id and date_trunc('second', a.ts) >= date_trunc('second', b.ts) - interval 30 minute and date_trunc('second', a.ts) <= date_trunc('second', b.ts) + interval 5 second
        join region on r_regionkey = coalesce(cast(json_extract_string(b.props, '$.k') as bigint), 0) % 5 where a.event_type = 'click' and b.event_type = 'purchase'""",
    "search_keywords": f"""with e as (select *, {_K} as k from events),
        d as (select ts, unnest(regexp_split_to_array(lower('No ' || event_type || ' ' || cast(k % 4 as varchar)), '{_GAP}')) as keyword from e where k % 3 <> 2 and k % 5 <> 0 and event_type <> 'error')
        select {_window('ts', 5)}, keyword, count(*) as keyword_count from d where keyword <> '' group by all""",
    "keyword_pieces": f"""with recursive lex as (select distinct word from (select unnest(regexp_split_to_array(lower(text), '{_GAP}')) as word from benchmark) where length(word) between 2 and 4),
        t as (select make_timestamp((1700000000 + conv_id * 100 + turn) * 1000000) as ts, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+|[\\p{{N}}_]+')) as run from conversations),
        runs as (select distinct run, length(run) as n from t where regexp_matches(run, '[\\p{{L}}\\p{{M}}]')),
        dp as (
            select run, n, 0 as p, 0 as j, struct_pack(o := 0, w := 0, s := 0, q := 0) as k, []::varchar[] as path from runs
            union all
            select run, n, p + 1, j, min(k), arg_min(path, k) from (
                select run, n, p, j + len as j, path || case when len > 0 then [piece] else [] end as path,
                       case when len = 0 then k else struct_pack(o := k.o + case when word is null then 1 else 0 end, w := k.w + 1, s := k.s + len * len, q := k.q - k.w * len) end as k
                from (select *, substr(run, j + 1, len) as piece from (select *, cast(unnest(range(0, 5)) as integer) as len from dp) where (len = 0 and j > p) or (len > 0 and j = p and j + len <= n)) left join lex on word = piece
                where len <= 1 or word is not null
            ) group by run, n, p, j
        ),
        pieces as (select run, unnest(path) as keyword from dp where p = n and j = n union all select distinct run, run from t where not regexp_matches(run, '[\\p{{L}}\\p{{M}}]'))
        select {_window('ts', 3600)}, keyword, count(*) as keyword_count from t join pieces using (run) group by all""",
    "latest_lines": f"""select * exclude (nth) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in _LINE.split(', '))}) as nth from lineitem) where nth = 1""",
    "times_as_text": """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, epoch_us(ts) // 1000 as from_ms, epoch_us(ts) // 1000000 as from_s, epoch_us(ts) // 1000000 * 1000 as whole_ms,
        epoch_us(ts) // 1000000 * 1000 - 28800000 as east_ms, epoch_us(ts) // 86400000000 * 86400000 as day_ms from events""",
    "log_split_pages": f"""with {_LOG} select 'm' || cast(user_id as varchar) as mid, cast(user_id as varchar) as uid, is_new, 'v' || cast(k % 3 as varchar) as vc, case when event_type = 'view' then 'home' else event_type end as page_id,
        case when k % 2 = 0 then 'search' end as last_page_id, cast(floor(value) as bigint) as during_time, ms as ts from log""",
    "log_split_starts": f"with {_LOG} select 'm' || cast(user_id as varchar) as mid, cast(user_id as varchar) as uid, is_new, 'icon' as start, ms as ts from log where event_type = 'signup'",
    "log_split_displays": f"with {_LOG} select 'm' || cast(user_id as varchar) as mid, cast(event_id as varchar) as item, 'sku_id' as item_type, cast(k % 10 as integer) as pos_id, 0 as pos_seq, ms as ts from log where event_type in ('view', 'click')",
    "log_split_actions": f"with {_LOG} select 'm' || cast(user_id as varchar) as mid, event_type as action_id, cast(event_id as varchar) as item, 'sku_id' as item_type, ms + 1 as ts from (select *, unnest(range(k % 3)) as i from log where event_type = 'click')",
    "log_split_errors": f"with {_LOG} select 'm' || cast(user_id as varchar) as mid, 'code ' || cast(k as varchar) as err, ms as ts from log where event_type = 'error'",
    "log_split_dirty": """select substr('{"common":{"mid":"m' || cast(user_id as varchar) || '","uid":"', 1, 20) as raw from events where event_id % 10 = 7 and event_id % 3 = 0""",
    "fact_route": f"with {_TOPIC_COUNTS} select 'dwd_' || tab || '_' || cast(n as varchar) as sink_table, id, order_id, cast(ts as bigint) as ts from records join active using (tab) where type = 'insert'",
    "dim_filter": f"with {_TOPIC_COUNTS} select 'dim_' || tab || '_' || cast(n as varchar) as sink_table, id as row_key, type, order_id, cast(ts as bigint) as ts from records join active using (tab)",
    "dim_upsert": """with r as (select *, max(case when event_type = 'error' then {'t': ts, 'e': event_id} end) over (partition by user_id) as gone from events)
        select user_id, arg_max(event_id, {'t': ts, 'e': event_id}) filter (event_type = 'click') as last_click, arg_max(props, {'t': ts, 'e': event_id}) filter (event_type = 'view' and props is not null) as last_view
        from r where event_type <> 'error' and (gone is null or {'t': ts, 'e': event_id} > gone) group by user_id""",
}
ORACLE["json_output"] = f"""with j as ({ORACLE["order_users_window"]})
    select stt, to_json({{'stt': stt, 'edt': edt, 'cur_date': cur_date, 'order_unique_user_count': order_unique_user_count, 'order_new_user_count': order_new_user_count}}) as line from j"""
ORACLE["keyed_facts_as_json"] = f"with j as ({ORACLE['cart_add_delta']}) select to_json({{'id': id, 'sku_num': sku_num}}) as value from j"
