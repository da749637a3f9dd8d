"""Dimension layer: keyed tables from change records, as their configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import key
from tidemark.operators.cdc import fold
from tidemark.operators.joins import dim_rows, only_columns


def dim_changes(topic: DataFrame, config: DataFrame, order: str | None = None, project: bool = False) -> DataFrame:
    """sink_table, row_key, type, data, ts of the configured tables' records; with `project` only the columns that the
    configuration lists."""
    rows = dim_rows(topic, config, order)
    data = only_columns("data", "sink_columns") if project else F.col("data")
    return rows.select("sink_table", F.try_element_at("data", F.col("sink_row_key")).alias("row_key"), "type", data.alias("data"), "ts")


def dim_table(changes: DataFrame, sink: str, columns: list[str], order: list[str]) -> DataFrame:
    """The dimension table after all changes: text columns by row key."""
    rows = changes.where(F.col("sink_table") == sink)
    wide = rows.select("row_key", "type", *order, *[key("data", c).alias(c) for c in columns])
    return fold(wide, ["row_key"], order, columns, F.col("type") == "delete")
