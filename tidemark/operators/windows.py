"""Tumbling windows with the columns that describe them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "yyyy-MM-dd HH:mm:ss"
COMPACT, DASHED = "yyyyMMdd", "yyyy-MM-dd"


def tumbling(rows: DataFrame, ts: str, size: str, measures: Sequence[Column], keys: Sequence[str | Column] = (), day: str = COMPACT, day_of: str = "start", distinct: dict[str, str] | None = None) -> DataFrame:
    """stt, edt, cur_date, the keys and the measures of each window that has rows.

    Sums are made in part before the shuffle. day_of says whether cur_date is that of the window's start or end. distinct: by
    name a column whose different values are counted exactly. On streams these have a state row each, dealt over all
    partitions, and the windows of rows are put together from theirs; measures must be sums then.
    """
    w = F.window(ts, size).alias("w")
    if not distinct:
        named = rows.groupBy(w, *keys).agg(*measures)
    elif not rows.isStreaming:
        named = rows.groupBy(w, *keys).agg(*[F.count_distinct(c).alias(n) for n, c in distinct.items()], *measures)
    else:
        ((name, column),) = distinct.items()
        each = rows.groupBy(w, *keys, F.col(column).alias("_id")).agg(*measures)
        same, sums = each.columns[1 : 1 + len(keys)], each.schema.fields[2 + len(keys) :]
        again = each.groupBy(F.window(F.window_time("w"), size).alias("v"), *same)
        named = again.agg(F.count("_id").alias(name), *[F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums]).withColumnRenamed("v", "w")
    names = [c for c in named.columns if c != "w"]
    return named.select(
        F.date_format("w.start", TEXT).alias("stt"), F.date_format("w.end", TEXT).alias("edt"), F.date_format(f"w.{day_of}", day).alias("cur_date"), *names
    )


def total(column: str, name: str, kind: str = "long") -> Column:
    return F.sum(column).cast(kind).alias(name)
