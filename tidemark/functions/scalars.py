"""Scalar expressions that the pipelines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(map_col: str | Column, name: str) -> Column:
    """Element of a map, null if the key is missing."""
    return F.try_element_at(col(map_col), F.lit(name))


def blank(c: str | Column) -> Column:
    """Null or empty."""
    return F.coalesce(col(c), F.lit("")) == ""


def event_time(ts: str | Column, precision: int = 3) -> Column:
    """Epoch seconds (0) or milliseconds (3) as a timestamp."""
    return F.timestamp_millis(col(ts)) if precision == 3 else F.timestamp_seconds(col(ts))


def seconds_to_ms(ts: str | Column) -> Column:
    return col(ts) * 1000


def day_of(ts: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Formatted day of a timestamp or of timestamp text."""
    return F.date_format(F.to_timestamp(col(ts)), fmt)


def ms_to_text(ts: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(col(ts)), fmt)


def text_to_ms(text: str | Column, zone: str = "+08:00") -> Column:
    """Epoch milliseconds of date or date-time text in a fixed zone."""
    c = col(text)
    whole = F.when(F.char_length(c) <= 10, F.concat(c, F.lit(" 00:00:00"))).otherwise(c)
    return F.unix_millis(F.to_timestamp(F.concat(whole, F.lit(zone))))


def amount(number: str | Column, price: str | Column) -> Column:
    """Product of two decimal texts, as text with all digits kept."""
    d = "decimal(16,2)"
    return (col(number).cast(d) * col(price).cast(d)).cast("string")


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from one timestamp to another, rounded towards zero."""
    gap = F.timestamp_diff("SECOND", col(earlier), col(later))
    return (gap / 86400).cast("long")


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def as_json(*columns: str | Column) -> Column:
    """The columns as JSON text, without those that are null."""
    return F.to_json(F.struct(*columns))


def words(text: str | Column, splitter: Column | None = None) -> Column:
    """Array of words: runs of letters, marks and digits of any script. Any expression that gives an array of text can take
    the place of the default splitter, as functions.segment does for scripts without spaces."""
    if splitter is not None:
        return F.filter(splitter, lambda w: w != "")
    # array_remove is compiled, a filter by a lambda is not
    return F.array_remove(F.split(F.lower(col(text)), r"[^\p{L}\p{M}\p{N}_]++"), "")
