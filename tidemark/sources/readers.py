"""Sources, each as a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import event_time
from tidemark.functions.schemas import CDC, PAGE_LOG


def strings(spark: SparkSession, where: str, *, stream: bool = False, fmt: str = "text", within: str | None = None, **options: str) -> DataFrame:
    """Column value: text records of a Kafka topic (fmt 'kafka', from the latest offset) or of text files.

    Records without a value are dropped. Kafka needs the connector's package on the class path; with `within`, records that were
    written again within that time are read once().
    """
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        options = {"subscribe": where} | ({"startingOffsets": "latest"} if stream else {}) | ({"includeHeaders": "true"} if within else {}) | options
        rows = reader.format("kafka").options(**options).load().withColumn("value", F.col("value").cast("string"))
        rows = once(rows, within) if within else rows.select("value")
    else:
        rows = reader.format(fmt).options(**options).load(where)
    return rows.where("value is not null")


def once(rows: DataFrame, within: str) -> DataFrame:
    """Column value of the records (value, timestamp, headers) without those whose id, which sinks.marked() gave them, has come before;
    on streams ids are kept for `within`. Records without an id all stay."""
    ident = F.try_element_at(F.filter("headers", lambda h: h["key"] == "id"), F.lit(1))["value"]
    rows = rows.select("value", "timestamp", F.coalesce(F.hex(ident), F.uuid()).alias("id"))
    kept = rows.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["id"]) if rows.isStreaming else rows.dropDuplicates(["id"])
    return kept.select("value")


def typed_json(rows: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Columns of the schema from JSON text; records that are no such JSON are skipped."""
    parsed = rows.select(F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object(value, "$").alias("whole"))
    return parsed.where("whole is not null and r is not null").select("r.*")


def with_time(rows: DataFrame, precision: int, delay: str, ts: str = "ts") -> DataFrame:
    """Adds event time et, processing time pt and the watermark."""
    rows = rows.withColumns({"et": event_time(ts, precision), "pt": F.current_timestamp()})
    return rows.withWatermark("et", delay)


def cdc(rows: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """Change records from JSON text."""
    return with_time(typed_json(rows, CDC), 0, delay)


def page_log(rows: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Page records with maps, from JSON text."""
    return with_time(typed_json(rows, PAGE_LOG), 3, delay)


def config_changes(rows: DataFrame, schema: str) -> DataFrame:
    """op, the configuration's columns and `at` from change JSON: the row before for deletions, else the row after. Changes
    come in the order of `at`, their time in milliseconds (zero where the record has none)."""
    parsed = typed_json(rows, schema)
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")).alias("c")
    return parsed.select("op", row, F.coalesce("ts_ms", F.lit(0)).alias("at")).select("op", "c.*", "at")


def jdbc_snapshot(spark: SparkSession, url: str, query: str, key: str | None = None, parts: int = 8, camel: bool = False, **options: str) -> DataFrame:
    """Rows of a query on a database. Needs the driver on the class path.

    With a numeric `key` column the query is read in `parts` tasks, one for each range between quantiles of the key, which one
    query for the key alone finds; rows without a key are in the first. With `camel`, names in capitals or with underscores get
    the form createTime; otherwise they stay as they are.
    """
    if key is None:
        rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    else:
        keys = spark.read.format("jdbc").options(url=url, query=f"select q.{key} as k from ({query}) q", **options).load().toDF("k")
        shares = [i / parts for i in range(1, parts)]
        cuts = keys.where("k is not null").select(F.percentile_approx("k", shares, 10_000).alias("cuts")).first()["cuts"] or []
        rows = spark.read.jdbc(url, f"({query}) q", predicates=key_ranges(f"q.{key}", cuts), properties=dict(options))
    return rows.toDF(*map(camel_case, rows.columns)) if camel else rows


def key_ranges(key: str, cuts: list) -> list[str]:
    """Conditions that each row fulfils one of: below the first cut or null, between two cuts, from the last one on."""
    cuts = sorted(set(cuts))
    if not cuts:
        return ["1 = 1"]
    between = [f"{key} >= {a} and {key} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"({key} < {cuts[0]} or {key} is null)", *between, f"{key} >= {cuts[-1]}"]


def camel_case(name: str) -> str:
    """CREATE_TIME and create_time as createTime; a name without underscores that is not all capitals stays."""
    if "_" not in name and not name.isupper():
        return name
    first, *rest = [part for part in name.lower().split("_") if part] or [""]
    return first + "".join(part.capitalize() for part in rest)


def dimension(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A keyed dimension table, as it is now."""
    return spark.read.format(fmt).load(path)


def dictionary(rows: DataFrame, code: str | Column, name: str | Column) -> DataFrame:
    """dic_code, info struct<dic_name> of any table of codes."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(c(code).cast("string").alias("dic_code"), F.struct(c(name).cast("string").alias("dic_name")).alias("info"))
