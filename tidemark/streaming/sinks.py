"""Sinks. Those that run on micro-batches can be given the same batch again and leave the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.streaming import store


def strings(rows: DataFrame, where: str, checkpoint: str, fmt: str = "text", **options: str) -> DataStreamWriter:
    """Appends the column value to a Kafka topic (fmt 'kafka') or to text files."""
    to = {"topic": where} if fmt == "kafka" else {"path": where}
    return rows.select("value").writeStream.format(fmt).options(checkpointLocation=checkpoint, **to, **options)


def routed(rows: DataFrame, where: str, checkpoint: str, fmt: str = "text", **options: str) -> DataStreamWriter:
    """Appends value to the topic that each row names; files are put in a folder for each topic."""
    out = rows.select("topic", "value").writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**options)
    return out if fmt == "kafka" else out.partitionBy("topic").option("path", where)


def console(rows: DataFrame) -> DataStreamWriter:
    return rows.writeStream.format("console")


def json_lines(path: str) -> Callable[[DataFrame, int], None]:
    """One JSON object a row, in a folder for each batch that a repeated batch replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def marked(batch: DataFrame, batch_id: int, writer: str = "") -> DataFrame:
    """The batch with `headers`, which give each record an id that it gets again when the batch comes again: a hash of writer, batch,
    topic and value, and how many records of the batch were equal to it. readers.once() drops what has come before by it."""
    same = ["topic", "value"] if "topic" in batch.columns else ["value"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    ident = F.sha2(F.to_json(F.struct(F.lit(writer).alias("w"), F.lit(batch_id).alias("b"), *same, nth.alias("n"))), 256)
    return batch.withColumn("headers", F.array(F.struct(F.lit("id").alias("key"), ident.cast("binary").alias("value"))))


def text_batches(where: str, fmt: str = "text", writer: str = "") -> Callable[[DataFrame, int], None]:
    """Column value to a Kafka topic, whose records are marked(), or to text files in a folder for each batch that a repeated batch
    replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if fmt == "kafka":
            marked(batch.select("value"), batch_id, writer).write.format("kafka").option("topic", where).save()
        else:
            batch.select("value").write.mode("overwrite").format(fmt).save(f"{where}/batch={batch_id}")

    return write


def routed_batches(where: str, fmt: str = "text", writer: str = "") -> Callable[[DataFrame, int], None]:
    """Column value to the topic that each row names, as routed() does; records of Kafka are marked(), and a repeated batch replaces
    its files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("topic", "value")
        if fmt == "kafka":
            marked(rows, batch_id, writer).write.format("kafka").save()
        else:
            rows = rows.withColumn("batch", F.lit(batch_id))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "batch").format(fmt).save(where)

    return write


def upsert(path: str, keys: list[str], order: list[str], files: int | None = None, writer: str = "") -> Callable[[DataFrame, int], None]:
    """Keeps the last row of each key, by the order columns, in a table (see store); read_table() gives the rows. `files` is the most that
    a part has. A batch that the writer has given before is left out: queries with checkpoints of their own are other writers."""
    table = store.Manifest("rows", keys, order, [])
    return lambda batch, batch_id: store.commit(batch, path, table, writer, batch_id, files)


def dim_upsert(path: str, keys: list[str], order: list[str], columns: list[str], files: int | None = None, writer: str = "") -> Callable[[DataFrame, int], None]:
    """Applies changes (keys, type, order, columns) to a dimension table: type 'delete' removes a key, anything else writes the
    columns that are not null. Each column keeps the place of its last change, so that changes may come late and again; deleted
    keys stay as marks."""
    table = store.Manifest("changes", keys, order, columns)
    return lambda batch, batch_id: store.commit(batch, path, table, writer, batch_id, files)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table as they are now. What is changed later does not show, also not in the middle of a query."""
    return store.read(spark, path)


def sync_stores(root: str, keys: tuple[str, ...] = ("row_key",), order: tuple[str, ...] = ("ts",)) -> Callable[[DataFrame, int], None]:
    """Makes and drops the dimension tables below `root`, which dim_upsert() writes, as configuration changes (op, sink_table,
    sink_columns, at) say: r and c make a table if there is none, d drops it with its rows, u puts an empty one in its place.
    A change that is not later than the last one that was met for a table is left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for row in batch.orderBy("at").collect():
            columns = [c.strip() for c in (row["sink_columns"] or "").split(",") if c.strip()]
            schema = ", ".join([*(f"{k} string" for k in keys), *(f"{o} bigint" for o in order), *(f"`{c.replace('`', '``')}` string" for c in columns)])
            store.follow(spark, f"{root}/{row['sink_table']}", row["op"], row["at"], list(keys), columns, list(order), schema)

    return write


def sync_tables(columns: str = "row_key string", database: str = "default", fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Creates and drops the catalog's dimension tables as configuration changes (op, sink_table, sink_columns) say: r and c
    create a table if there is none, d drops it, u drops and creates it anew. Changes are few, and are met in the order of
    `at` if they have it."""
    quoted = lambda name: "`" + name.replace("`", "``") + "`"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for row in (batch.orderBy("at") if "at" in batch.columns else batch).collect():
            name = f"{quoted(database)}.{quoted(row['sink_table'])}"
            fields = ", ".join([columns, *[f"{quoted(c.strip())} string" for c in (row["sink_columns"] or "").split(",") if c.strip()]])
            if row["op"] in ("d", "u"):
                spark.sql(f"drop table if exists {name}")
            if row["op"] != "d":
                spark.sql(f"create table if not exists {name} ({fields}) using {fmt}")

    return write


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> DataStreamWriter:
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)


def fan_out(writers: dict[str, Callable[[DataFrame, int], None]], split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """Splits a batch and gives each part to its writer; the batch is read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, part in split(batch).items():
                if name in writers:
                    writers[name](part, batch_id)
        finally:
            batch.unpersist()

    return write
