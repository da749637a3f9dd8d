"""App logs: parsing, dirty records, exploding and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schemas import LOG


def parsed(rows: DataFrame, value: str = "value", strict: bool = False, schema: str = LOG) -> tuple[DataFrame, DataFrame]:
    """(records with the columns of a log, or of another schema, and `raw`, dirty text). Dirty is what is no JSON object; a field of
    another kind is null. A strict reader fails on the first dirty record.

    Each line is parsed once; only one that does not fit the schema is looked at again, for whether it is an object at all.
    """
    if strict:
        mode = {"mode": "FAILFAST"}
        return rows.select(F.from_json(value, schema, mode).alias("r"), F.col(value).alias("raw")).select("r.*", "raw"), rows.limit(0)
    odd = {"columnNameOfCorruptRecord": "_odd"}
    both = rows.select(F.from_json(value, f"{schema}, _odd string", odd).alias("r"), F.col(value).alias("raw"))
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    good = F.when(F.col("r").isNull() | ~F.ltrim("raw").startswith("{"), False).when(F.col("r._odd").isNull(), True).otherwise(object_)
    return both.where(good).select("r.*", "raw").drop("_odd"), both.where(~good).select("raw")


def pages(log: DataFrame) -> DataFrame:
    return log.where("page is not null").select("common.*", "page.*", "ts")


def starts(log: DataFrame) -> DataFrame:
    return log.where("start is not null").select("common.*", "start", "ts")


def errors(log: DataFrame) -> DataFrame:
    return log.where("err is not null").select("common.*", "err", "ts")


def _each(log: DataFrame, array: str, *more: str) -> DataFrame:
    rows = log.select("common", F.explode(array).alias("e"), *more)
    own = [f for f in rows.schema["e"].dataType.names if f not in rows.schema["common"].dataType.names]
    return rows.select("common.*", *[F.col(f"e.{f}").alias(f) for f in own], *more)


def displays(log: DataFrame) -> DataFrame:
    """One row a display, with the common fields and the record's time."""
    return _each(log, "displays", "ts")


def actions(log: DataFrame) -> DataFrame:
    """One row an action, with the common fields; the time is the action's own."""
    return _each(log, "actions")


def split(log: DataFrame) -> dict[str, DataFrame]:
    """The outputs of the log by name; page rows leave out what goes to the others."""
    return {"page": pages(log), "start": starts(log), "err": errors(log), "display": displays(log), "action": actions(log)}


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))
