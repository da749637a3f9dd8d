"""Joins: intervals, lookups, enrichment chains and routing by configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import words
from tidemark.operators.cdc import active_config

#: Rows of configuration up to which it is sent to all tasks; beyond, Spark chooses.
SMALL = 10_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Marks a batch table for broadcast if it has no more than so many rows; otherwise Spark decides by its size."""
    if df.isStreaming:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, before: str, after: str) -> DataFrame:
    """Pairs of equal keys whose left time lies in [right time - before, right time + after], both ends included."""
    near = (F.col(f"l.{left_ts}") >= F.col(f"r.{right_ts}") - F.expr(f"interval {before}")) & (F.col(f"l.{left_ts}") <= F.col(f"r.{right_ts}") + F.expr(f"interval {after}"))
    for k in on:
        near &= F.col(f"l.{k}") == F.col(f"r.{k}")
    return left.alias("l").join(right.alias("r"), near)


def lookup(rows: DataFrame, dic: DataFrame, code: str, name: str) -> DataFrame:
    """The dictionary's name of a code; rows without one are dropped."""
    names = dic.select(F.col("dic_code").alias(code), F.col("info.dic_name").alias(name))
    return rows.join(names, code)


def enrich(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, take: dict[str, str]) -> DataFrame:
    """Adds columns of the dimension row of a key under new names, null where there is none."""
    fields = dim.select(F.col(dim_key).alias("_key"), *[F.col(a).alias(b) for a, b in take.items()])
    return rows.join(fields, rows[key] == fields["_key"], "left").drop("_key")


def enrich_chain(rows: DataFrame, steps: Sequence[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """Several enrichments in a row; a later key may be a column that an earlier step took."""
    for dim, key, dim_key, take in steps:
        rows = enrich(rows, dim, key, dim_key, take)
    return rows


def found_or_missing(rows: DataFrame, steps: Sequence[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """enrich_chain() with a column `missing`: a key is not null, but has no dimension row."""
    missing = F.lit(False)
    for i, (dim, key, dim_key, take) in enumerate(steps):
        rows = enrich(rows, dim.withColumn("_hit", F.lit(True)), key, dim_key, take | {"_hit": f"_hit{i}"})
        missing = missing | (F.col(key).isNotNull() & F.col(f"_hit{i}").isNull())
    return rows.withColumn("missing", missing).drop(*[f"_hit{i}" for i in range(len(steps))])


def dim_rows(topic: DataFrame, config: DataFrame, order: str | None = None) -> DataFrame:
    """Change records of the configured dimension tables that carry data, each with its configuration."""
    routes = active_config(config, ["source_table"], order)
    rows = topic
    if not (topic.isStreaming or routes.isStreaming):
        names = [r[0] for r in routes.select("source_table").limit(SMALL + 1).collect()]
        if len(names) <= SMALL:  # records of other tables go before their data is looked at
            rows, routes = rows.where(F.col("table").isin(names)), F.broadcast(routes)
    else:
        routes = small(routes)
    rows = rows.where(F.size("data") > 0)
    return rows.join(routes, rows["table"] == routes["source_table"])


def fact_rows(topic: DataFrame, config: DataFrame, preloaded: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Change records routed by (table, type): live configuration first, the preloaded one for keys that it lacks."""
    keys = ["source_table", "source_type"]
    routes = active_config(config, keys, order)
    if preloaded is not None:
        touched = config.select(*keys).distinct()
        routes = routes.unionByName(preloaded.select(*routes.columns).join(touched, keys, "left_anti"))
    routes = small(routes)
    return topic.join(routes, (topic["table"] == routes["source_table"]) & (topic["type"] == routes["source_type"]))


def only_columns(data: str | Column, names: str | Column) -> Column:
    """The elements of a map that a comma-separated list names."""
    c = F.col(data) if isinstance(data, str) else data
    n = F.col(names) if isinstance(names, str) else names
    # the list is split once a row, not once an element
    return F.transform(F.array(F.split(n, r"\s*,\s*")), lambda few: F.map_filter(c, lambda k, _: F.array_contains(few, k)))[0]


def keywords(rows: DataFrame, text: str, splitter: Column | None = None) -> DataFrame:
    """One row for each word of the text, none for null."""
    return rows.withColumn("keyword", F.explode(words(text, splitter)))
