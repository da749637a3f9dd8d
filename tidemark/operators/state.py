"""Keyed states. In batch a window over each key in event order takes the place of stored values; streams keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import blank, or_zero, whole_days
from tidemark.streaming import state as stream


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def day(ts: str) -> Column:
    return F.to_date(ts)


def first_of_day(rows: DataFrame, keys: list[str], ts: str, order: list[str], where: Column | None = None, expires: bool = False, history: DataFrame | None = None) -> DataFrame:
    """Rows whose day differs from that of the key's row before, with last_day (null at the first row ever).

    On streams a state `expires` where last_day is not asked for, and history is a batch of the rows before the stream; batch
    rows have their history among them.

    In batch the first row of a key's day is found by a partial minimum before the shuffle, so that a key with very many
    rows sends one for each day and task; only days are put in order. Rows of nothing but the keys and the time (see times()) need a
    minimum of numbers, for which none are sorted."""
    if where is not None:
        rows, history = rows.where(where), history.where(where) if history is not None else None
    if rows.isStreaming:
        return stream.first_of_day(rows, keys, ts, order, expires=expires, history=history)
    ids = [f"_key{i}" for i in range(len(keys))]
    by = [F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)]
    days = rows.groupBy(*by, day(ts).alias("_day"))
    if order == [ts] and set(rows.columns) == {*keys, ts}:
        days = days.agg(F.min(ts).alias("_ts")).withColumn("_row", F.struct(*[F.col(i).alias(k) for k, i in zip(keys, ids, strict=True)], F.col("_ts").alias(ts)))
    else:
        days = days.agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    firsts = days.withColumn("last_day", F.lag("_day").over(_over(ids, ["_day"]))).where(~F.col("last_day").eqNullSafe(F.col("_day")))
    return firsts.select("_row.*", "last_day")


def times(rows: DataFrame | None, keys: list[str], ts: str, order: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The rows with nothing but keys and time where these alone decide: which of several rows of one time is the first is all
    the same for who counts times."""
    if order[0] != ts or ts in keys:
        return rows, order
    return rows.select(*keys, ts) if rows is not None else None, [ts]


def unique_and_new(rows: DataFrame, user: str, ts: str, order: list[str], history: DataFrame | None = None) -> DataFrame:
    """First rows of a user's day, with uu = 1 and new = 1 for the first day ever."""
    firsts = first_of_day(rows, [user], ts, order, history=history)
    return firsts.withColumns({"uu": F.lit(1), "new": F.col("last_day").isNull().cast("int")})


def returning(rows: DataFrame, user: str, ts: str, order: list[str], days: int = 7, history: DataFrame | None = None) -> DataFrame:
    """First rows of a user's day, with uu = 1 and back = 1 if more than `days` whole days passed since the last day began."""
    firsts = first_of_day(rows, [user], ts, order, history=history)
    gap = whole_days(F.col(ts), F.col("last_day").cast(firsts.schema[ts].dataType))
    return firsts.withColumns({"uu": F.lit(1), "back": F.coalesce(gap > days, F.lit(False)).cast("int")})


def login_rows(rows: DataFrame, user: str = "uid", last_page: str = "last_page_id") -> DataFrame:
    """Rows at which a user enters: the user is known, and came from nowhere or from the login page."""
    return rows.where(~blank(F.col(user).cast("string")) & (blank(last_page) | (F.col(last_page) == "login")))


def view_measures(last_page: str = "last_page_id", during: str = "during_time") -> list[Column]:
    """sv (a session starts), pv = 1 and dur of a page row."""
    return [blank(last_page).cast("int").alias("sv"), F.lit(1).alias("pv"), or_zero(during).cast("long").alias("dur")]


def page_measures(rows: DataFrame, visitor: str, ts: str, order: list[str], last_page: str = "last_page_id", during: str = "during_time") -> DataFrame:
    """Every row with uv (first of the visitor's day), sv (a session starts), pv = 1 and dur."""
    last = F.lag(day(ts)).over(_over([visitor], order))
    if rows.isStreaming:
        rows, last = stream.first_of_day(rows, [visitor], ts, order, every=True, expires=True), F.col("last_day")
    return rows.withColumn("uv", (~last.eqNullSafe(day(ts))).cast("int")).select("*", *view_measures(last_page, during))


def home_and_detail(rows: DataFrame, visitor: str, ts: str, order: list[str], page: str = "page_id") -> DataFrame:
    """First rows of a visitor's day on the home page and on the detail page, each counted for itself."""
    firsts = first_of_day(rows, [visitor, page], ts, order, F.col(page).isin("home", "good_detail"), expires=True)
    return firsts.withColumns({"home_uv": (F.col(page) == "home").cast("int"), "good_detail_uv": (F.col(page) == "good_detail").cast("int")})


def deltas(rows: DataFrame, keys: list[str], measures: list[str], order: list[str], ts: str | None = None, max_gap: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """Each measure less its last value for the same key, so that sums count a repeated record once, as last seen. A null
    measure is zero.

    With max_gap (seconds), a record that comes later than that after the one before counts in full; on streams, which need
    ts, the state of a key then lasts no longer either.
    """
    if rows.isStreaming:
        return stream.deltas(rows, keys, measures, order, ts, max_gap, history)
    over = _over(keys, order)
    far = F.lit(False)
    if max_gap is not None:
        far = F.coalesce(F.timestamp_diff("SECOND", F.lag(ts).over(over), F.col(ts)) > max_gap, F.lit(False))
    return rows.withColumns({m: or_zero(m) - F.when(far, F.lit(0)).otherwise(or_zero(F.lag(m).over(over))) for m in measures})


def repaired_visitors(rows: DataFrame, visitor: str, ts: str, flag: str, order: list[str], timed: bool = True, history: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The flag of new visitors, set to '0' where the visitor was there on an earlier day.

    A visitor whose first row is not flagged as new was there the day before at the latest. On streams `timed` drops late
    rows and lets windows follow; without it all rows pass. In batch `seen` may give visitor, ts, flag and order of the same rows,
    where they are cheaper to have.
    """
    if rows.isStreaming:
        return stream.repaired_visitors(rows, visitor, ts, flag, order, timed, history)
    began = F.min_by(F.struct(F.col(flag).alias("flag"), day(ts).alias("day")), F.struct(*order)).alias("_began")
    firsts = (rows if seen is None else seen).groupBy(F.col(visitor).alias("_visitor")).agg(began)
    joined = rows.join(firsts, F.col(visitor).eqNullSafe(F.col("_visitor")), "left")
    first = F.when(F.col("_began.flag").eqNullSafe(F.lit("1")), F.col("_began.day")).otherwise(F.date_sub("_began.day", 1))
    seen = (F.col(flag) == "1") & (first < day(ts))
    return joined.withColumn(flag, F.when(seen, F.lit("0")).otherwise(F.col(flag))).select(*rows.columns)
