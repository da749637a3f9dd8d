"""Change records: filters, status transitions, deltas, and folding changes to the latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import key


def changes(topic: DataFrame, table: str, kind: str | None = None, database: str | None = None) -> DataFrame:
    """Records of a table, of one kind and database where given."""
    rows = topic.where(F.col("table") == table)
    if kind:
        rows = rows.where(F.col("type") == kind)
    return rows.where(F.col("database") == database) if database else rows


def pick(rows: DataFrame, *names: str, extra: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Elements of data as columns; 'a as b' renames."""
    pairs = [(n.split(" as ") * 2)[:2] for n in names]
    return rows.select(*[key("data", a).alias(b) for a, b in pairs], *extra)


def became(column: str, now: str, before: str | None = None) -> Column:
    """The column changed to `now`: from `before`, or from anything."""
    old = key("old", column)
    return (key("data", column) == now) & ((old == before) if before else old.isNotNull())


def added(column: str) -> Column:
    """What an insert or update adds to a number: null where it adds nothing."""
    new, old = key("data", column).cast("int"), key("old", column).cast("int")
    delta = F.when(F.col("type") == "insert", new).when((F.col("type") == "update") & (new > old), new - old)
    return delta


def latest(rows: DataFrame, keys: list[str], order: list[str], gone: Column | None = None) -> DataFrame:
    """The last row of each key, found by a partial maximum before the shuffle; keys whose last row is `gone` leave."""
    rest = [c for c in rows.columns if c not in keys]
    flags = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    last = F.max(F.struct(*order, F.struct(flags.alias("gone"), *rest).alias("row"))).alias("last")
    kept = rows.groupBy(*keys).agg(last).where("not last.row.gone")
    return kept.select(*keys, *[F.col(f"last.row.{c}").alias(c) for c in rest])


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], deleted: Column) -> DataFrame:
    """State of keyed rows after all changes: a deletion removes the key, a null keeps the column's old value.

    Every column takes its last value that is not null since the key's last deletion.
    """
    at = F.struct(*order)
    reset = F.max(F.when(deleted, at)).over(Window.partitionBy(*keys))
    live = rows.withColumns({"_at": at, "_reset": reset}).where(~deleted & (F.col("_reset").isNull() | (F.col("_at") > F.col("_reset"))))
    return live.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in columns])


def active_config(config: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Routing rows in force: the last change of each key, unless it is a deletion. config has op and, if it holds more
    than one change of a key, an order column."""
    return latest(config, keys, [order] if order else ["op"], F.col("op") == "d").drop("op", *([order] if order else []))
