"""The twenty-one jobs: what each reads, what it makes of it, and the kind of sink it writes to.

build(topics, dims) takes DataFrames of text (column value) by topic name and DataFrames by dimension name, and gives the output
rows; it serves batch frames. A job that takes names from dimensions has a form for streams too: the streaming part gives rows
with keys, and every micro-batch meets the dimensions as they are by then. start() wires a job to its source and sink,
start_config() keeps the table of a configuration from its changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import event_time
from tidemark.functions.schemas import CART_ADD, DIM_CONFIG, FACT_CONFIG, LOG, ORDER_DETAIL
from tidemark.functions.segment import segmenter
from tidemark.operators import logs
from tidemark.operators.cdc import active_config
from tidemark.operators.joins import enrich_chain, found_or_missing
from tidemark.plans import dim, dwd, dws
from tidemark.sources import readers
from tidemark.streaming import sinks, store

Frames = dict[str, DataFrame]
Dims = dict[str, DataFrame | Callable[[], DataFrame]]
Writer = Callable[[DataFrame, int], None]
WITHIN, SHORT, CORRECTED = "30 seconds", "5 seconds", 30
#: Seconds for which a stream keeps the last amounts of an order detail.
PROVINCE_GAP, SKU_GAP = 60, 10
#: Micro-batches for which a summary waits for a missing name before it goes out without.
PATIENCE = 3
REFUND = "id string, user_id string, order_id string, sku_id string, province_id string, date_id string, create_time string, refund_num string, refund_amount string, ts bigint"
PAYMENT = "order_detail_id string, order_id string, user_id string, split_payment_amount string, ts bigint"
REGISTER = "user_id string, create_time string"


@dataclass(frozen=True)
class Names:
    """Where the rows of a stream get names from: the dimensions one after the other, and what becomes of the named rows. A row
    of a `strict` job is never given out without all its names, as an inner join would have it; others wait for a while."""

    chain: Callable[[Frames], dws.Chain]
    shape: Callable[[DataFrame], DataFrame] = lambda rows: rows
    strict: bool = False


@dataclass(frozen=True)
class Job:
    build: Callable[[Frames, Frames], DataFrame | Frames]
    topics: tuple[str, ...]
    sink: str
    dims: tuple[str, ...] = ()
    keys: tuple[str, ...] = field(default=())
    stream: Callable[[Frames], DataFrame] | None = None
    names: Names | None = None
    whole: Callable[[DataFrame, Frames], DataFrame] | None = None
    order: tuple[str, ...] = ("ts",)


def _facts(lines: DataFrame, schema: str, delay: str = "3 seconds") -> DataFrame:
    return readers.with_time(readers.typed_json(lines, schema), 0, delay)


def _pages(lines: DataFrame, delay: str = "3 seconds") -> DataFrame:
    rows = logs.pages(readers.typed_json(lines, LOG))
    return rows.withColumn("et", event_time("ts")).withWatermark("et", delay)


def _decimals(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("decimal(16,2)") for c in columns})


def _bound(topic: DataFrame, within: str) -> str | None:
    return within if topic.isStreaming else None


def _dim(t: Frames, d: Frames) -> DataFrame:
    return dim.dim_changes(readers.cdc(t["topic_db"]), _config(d["dim_config"]), "at")


def _config(changes: DataFrame) -> DataFrame:
    return changes if "at" in changes.columns else changes.withColumn("at", F.lit(0))


def _cancels(t: Frames, d: Frames) -> DataFrame:
    topic = readers.cdc(t["topic_db"])
    return dwd.order_cancels(topic, _facts(t["order_detail"], ORDER_DETAIL), within=_bound(topic, SHORT))


def _registered(lines: DataFrame) -> DataFrame:
    """create_time is text, or epoch milliseconds."""
    rows = readers.typed_json(lines, REGISTER)
    c = F.col("create_time")
    at = F.coalesce(F.timestamp_millis(F.try_to_number(c, F.lit("9999999999999")).cast("long")), F.try_to_timestamp(c))
    return rows.withColumn("et", at).withWatermark("et", "3 seconds")


def _detail_sums(lines: DataFrame, *columns: str) -> DataFrame:
    return _decimals(_facts(lines, ORDER_DETAIL), *columns)


def _province_sums(t: Frames, max_gap: int | None = None) -> DataFrame:
    return dws.province_sums(_detail_sums(t["order_detail"], "split_total_amount"), ["id"], "et", ["et", "split_total_amount"], max_gap=max_gap)


def _province_chain(d: Frames) -> dws.Chain:
    return [(d["province"], "province_id", "id", {"name": "province_name"})]


def _sku_sums(t: Frames, max_gap: int | None = None) -> DataFrame:
    measures = list(dws.SKU_MEASURES.values())
    return dws.sku_sums(_detail_sums(t["order_detail"], *measures), ["id"], "et", ["et", *measures], max_gap=max_gap)


def _sku_chain(d: Frames) -> dws.Chain:
    return [
        (d["sku"], "sku_id", "id", {"sku_name": "sku_name", "spu_id": "spu_id", "tm_id": "trademark_id", "category3_id": "category3_id"}), (d["spu"], "spu_id", "id", {"spu_name": "spu_name"}),
        *_brand_chain(d),
    ]


def _brand_chain(d: Frames) -> dws.Chain:
    return [
        (d["trademark"], "trademark_id", "id", {"tm_name": "trademark_name"}), (d["category3"], "category3_id", "id", {"name": "category3_name", "category2_id": "category2_id"}),
        (d["category2"], "category2_id", "id", {"name": "category2_name", "category1_id": "category1_id"}), (d["category1"], "category1_id", "id", {"name": "category1_name"}),
    ]


_BRAND = ["trademark_id", "category3_id", "user_id"]


def _sku_of_refunds(d: Frames) -> dws.Chain:
    return [(d["sku"], "sku_id", "id", {"tm_id": "trademark_id", "category3_id": "category3_id"})]


def _refund_sums(t: Frames, d: Frames) -> DataFrame:
    return dws.refunds_by_brand(_facts(t["order_refund"], REFUND), "et", _sku_of_refunds(d), _BRAND, _brand_chain(d))


def _codes(fact: str, shape: Callable[[DataFrame], DataFrame]) -> Names:
    """Names of codes from the dictionary; a row without a code has none."""
    names = dwd.NAMES[fact]
    some = lambda rows: shape(rows.where(" and ".join(f"{code} is not null" for code in names)))
    return Names(lambda d: [(d["dic"], code, "dic_code", {"info.dic_name": name}) for code, name in names.items()], some, strict=True)


def _keywords(t: Frames, d: Frames) -> DataFrame:
    """With a dimension `lexicon` (word), scripts without spaces are split by it; it stays as it was at the start."""
    rows = dws.search_rows(_pages(t["page_log"], "5 seconds"))
    split = segmenter(rows.sparkSession, d["lexicon"])("item") if "lexicon" in d else None
    return dws.keyword_counts(rows, "item", "et", splitter=split)


_DIC, _CATEGORY = ("dic",), ("trademark", "category3", "category2", "category1")
JOBS: dict[str, Job] = {
    "dimensions": Job(_dim, ("topic_db",), "dim", ("dim_config",), ("sink_table", "row_key")),
    "log_split": Job(lambda t, d: {k: logs.json_lines(v) if k != "dirty" else v.withColumnRenamed("raw", "value") for k, v in dwd.split_log(t["topic_log"]).items()}, ("topic_log",), "topics"),
    "fact_route": Job(lambda t, d: dwd.routed_facts(readers.cdc(t["topic_db"]), _config(d["fact_config"]), d.get("fact_snapshot"), "at"), ("topic_db",), "routed", ("fact_config",)),
    "comments": Job(
        lambda t, d: dwd.comments(readers.cdc(t["topic_db"]), d["dic"]), ("topic_db",), "upsert", _DIC, ("id",),
        stream=lambda t: dwd.comment_rows(readers.cdc(t["topic_db"])), names=_codes("comments", dwd.comment_facts),
    ),
    "cart_adds": Job(lambda t, d: dwd.cart_adds(readers.cdc(t["topic_db"])), ("topic_db",), "upsert", (), ("id",)),
    "order_details": Job(
        lambda t, d: dwd.order_details(readers.cdc(t["topic_db"])), ("topic_db",), "upsert", (), ("id",),
        stream=lambda t: dwd.corrected_order_details(readers.cdc(t["topic_db"]), CORRECTED), order=("ts", "version"),
    ),
    "order_cancels": Job(_cancels, ("topic_db", "order_detail"), "upsert", (), ("id",)),
    "payments": Job(
        lambda t, d: dwd.payments(readers.cdc(t["topic_db"]), _facts(t["order_detail"], ORDER_DETAIL), d["dic"]), ("topic_db", "order_detail"), "upsert", _DIC, ("order_detail_id",),
        stream=lambda t: dwd.payment_rows(readers.cdc(t["topic_db"]), _facts(t["order_detail"], ORDER_DETAIL)), names=_codes("payments", dwd.payment_facts),
    ),
    "refunds": Job(
        lambda t, d: dwd.refunds(readers.cdc(t["topic_db"]), d["dic"]), ("topic_db",), "upsert", _DIC, ("id",),
        stream=lambda t: dwd.refund_rows(readers.cdc(t["topic_db"]), within=SHORT), names=_codes("refunds", dwd.refund_facts),
    ),
    "refunds_paid": Job(
        lambda t, d: dwd.refunds_paid(readers.cdc(t["topic_db"]), d["dic"]), ("topic_db",), "upsert", _DIC, ("id",),
        stream=lambda t: dwd.refund_paid_rows(readers.cdc(t["topic_db"]), within=WITHIN), names=_codes("refunds_paid", dwd.refund_paid_facts),
    ),
    "keyword_counts": Job(_keywords, ("page_log",), "json"),
    "page_views": Job(lambda t, d: dws.page_views(_pages(t["page_log"]), "mid", "et", ["et", "page_id"]), ("page_log",), "json"),
    "home_detail_visitors": Job(lambda t, d: dws.home_detail_visitors(_pages(t["page_log"]), "mid", "et", ["et", "page_id"]), ("page_log",), "json"),
    "logins": Job(lambda t, d: dws.logins(_pages(t["page_log"]), "uid", "et", ["et", "page_id"]), ("page_log",), "json"),
    "registrations": Job(lambda t, d: dws.registrations(_registered(t["user_register"]), "et"), ("user_register",), "json"),
    "cart_users": Job(lambda t, d: dws.cart_users(_facts(t["cart_add"], CART_ADD, "5 seconds"), "user_id", "et", ["et", "id"]), ("cart_add",), "json"),
    "paying_users": Job(lambda t, d: dws.paying_users(_facts(t["payment"], PAYMENT), "user_id", "et", ["et", "order_detail_id"]), ("payment",), "json"),
    "ordering_users": Job(lambda t, d: dws.ordering_users(_facts(t["order_detail"], ORDER_DETAIL), "user_id", "et", ["et", "id"]), ("order_detail",), "json"),
    "province_orders": Job(
        lambda t, d: enrich_chain(_province_sums(t), _province_chain(d)), ("order_detail",), "json", ("province",),
        stream=lambda t: _province_sums(t, PROVINCE_GAP), names=Names(_province_chain),
    ),
    "sku_orders": Job(
        lambda t, d: enrich_chain(_sku_sums(t), _sku_chain(d)), ("order_detail",), "json", ("sku", "spu", *_CATEGORY),
        stream=lambda t: _sku_sums(t, SKU_GAP), names=Names(_sku_chain),
    ),
    "refund_sums": Job(
        _refund_sums, ("order_refund",), "json", ("sku", *_CATEGORY),
        stream=lambda t: dws.refunded_orders(_facts(t["order_refund"], REFUND), "et"), whole=lambda rows, d: dws.brands_of_refunds(rows, _sku_of_refunds(d), _BRAND, _brand_chain(d)),
    ),
}


def dim_config(lines: DataFrame) -> DataFrame:
    return readers.config_changes(lines, DIM_CONFIG)


def fact_config(lines: DataFrame) -> DataFrame:
    return readers.config_changes(lines, FACT_CONFIG)


#: How each configuration is read, and what it is keyed by.
CONFIGS: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "dim_config": (dim_config, ("source_table",)),
    "fact_config": (fact_config, ("source_table", "source_type")),
}


def start_config(name: str, spark: SparkSession, place: str, out: str, checkpoint: str, fmt: str = "text", available_now: bool = False, database: str = "default", tables: str | None = None, **options: str) -> StreamingQuery:
    """Keeps the last change of each configuration key in a table at `out`, deletions as such, which is there, if empty, from the
    start. Changes of dimensions also make, drop and empty the tables below `tables`, where the job `dimensions` writes them;
    without it, the catalog's tables. start() takes `lambda: sinks.read_table(spark, out)` as a live configuration."""
    parse, keys = CONFIGS[name]
    rows = parse(readers.strings(spark, place, stream=True, fmt=fmt, **options))
    if store.manifest(spark, out) is None:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        store.create(spark, out, list(keys), [], ["at"], schema, kind="rows")
    keep = sinks.upsert(out, list(keys), ["at"], writer=checkpoint)
    follow = sinks.sync_stores(tables) if tables else sinks.sync_tables(database=database)

    def write(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id)
        if name == "dim_config":
            follow(batch, batch_id)

    writer = sinks.each_batch(rows, write, checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start(name: str, spark: SparkSession, places: dict[str, str], dims: Dims, out: str, checkpoint: str, fmt: str = "text", sink_fmt: str = "text", dim_columns: dict[str, list[str]] | None = None, available_now: bool = False, patience: int = PATIENCE, **options: str) -> list[StreamingQuery]:
    """Starts a job on its topics (places: topic -> Kafka topic or folder). A dimension or configuration given as a function is read
    anew by each micro-batch, which sees one version of it. Rows whose names are not there yet wait, beside the checkpoint, for the
    next micro-batches: facts for as long as it takes, summaries for `patience` of them. The log is split in one pass, beside
    its dirty lines."""
    job = JOBS[name]
    topics = {t: readers.strings(spark, places[t], stream=True, fmt=fmt, **options) for t in job.topics}
    if job.sink in ("dim", "routed"):
        mark = f"{checkpoint}/{name}"
        write = _routing(job, dims, out, sink_fmt, dim_columns, mark)
        writer = sinks.each_batch(topics[job.topics[0]], write, mark)
        return [(writer.trigger(availableNow=True) if available_now else writer).start()]
    if job.sink == "topics":
        log, dirty = dwd.repaired_log(topics[job.topics[0]])
        place = lambda part: part if sink_fmt == "kafka" else f"{out}/{part}"
        parts = {p: sinks.text_batches(place(p), sink_fmt, f"{checkpoint}/log") for p in ("page", "start", "err", "display", "action")}
        split = lambda batch: {k: logs.json_lines(v) for k, v in logs.split(batch).items()}
        writers = [
            sinks.each_batch(log, sinks.fan_out(parts, split), f"{checkpoint}/log"),
            sinks.strings(dirty.withColumnRenamed("raw", "value"), place("dirty"), f"{checkpoint}/dirty", sink_fmt),
        ]
        return [(w.trigger(availableNow=True) if available_now else w).start() for w in writers]
    mark = f"{checkpoint}/{name}"
    rows = job.stream(topics) if job.stream else job.build(topics, {k: v() if callable(v) else v for k, v in dims.items()})
    write = sinks.upsert(out, list(job.keys), list(job.order), writer=mark) if job.sink == "upsert" else sinks.json_lines(out)
    if job.names or job.whole:
        write = _naming(job, dims, write, f"{checkpoint}/{name}-waiting", patience)
    writer = sinks.each_batch(rows, write, mark)
    return [(writer.trigger(availableNow=True) if available_now else writer).start()]


def _naming(job: Job, dims: Dims, write: Writer, waiting: str, patience: int) -> Writer:
    """Gives the rows of each batch, and those that still wait, the names that the dimensions have now. The rows that have to wait
    are stored under the number of the batch, so that a batch that comes again finds what it found before."""

    def named(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = {k: v() if callable(v) else v for k, v in dims.items()}
        if job.whole:
            write(job.whole(batch, now), batch_id)
            return
        columns, rows = batch.columns, batch.withColumn("_since", F.lit(batch_id).cast("long"))
        if store.exists(spark, f"{waiting}/batch={batch_id - 1}"):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{waiting}/batch={batch_id - 1}"))
        found = found_or_missing(rows, job.names.chain(now)).persist()
        try:
            late = F.col("missing") if job.names.strict else F.col("missing") & (F.col("_since") > batch_id - patience)
            write(job.names.shape(found.where(~late).drop("missing", "_since")), batch_id)
            found.where(late).select(*columns, "_since").write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
        finally:
            found.unpersist()
        store.delete(spark, f"{waiting}/batch={batch_id - 2}")

    return named


def _routing(job: Job, dims: Dims, out: str, fmt: str, columns: dict[str, list[str]] | None, mark: str) -> Writer:
    """Routes a batch's records by the configuration as it is now, to topics or to dimension tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = {k: v() if callable(v) else v for k, v in dims.items()}
        batch.persist()
        try:
            rows = job.build({job.topics[0]: batch}, now)
            if job.sink == "routed":
                sinks.routed_batches(out, fmt, mark)(rows, batch_id)
            else:
                _write_dims(rows, out, columns or _dim_columns(now["dim_config"]), batch_id, mark)
        finally:
            batch.unpersist()

    return write


def _dim_columns(config: DataFrame) -> dict[str, list[str]]:
    """The columns of each dimension table in force; configurations are few."""
    rows = active_config(_config(config), ["source_table"], "at").select("sink_table", "sink_columns").collect()
    return {r["sink_table"]: [c.strip() for c in (r["sink_columns"] or "").split(",") if c.strip()] for r in rows}


def _write_dims(changes: DataFrame, out: str, columns: dict[str, list[str]], batch_id: int, mark: str) -> None:
    for table, names in columns.items():
        rows = changes.where(F.col("sink_table") == table)
        wide = rows.select("row_key", "type", "ts", *[F.try_element_at("data", F.lit(c)).alias(c) for c in names])
        sinks.dim_upsert(f"{out}/{table}", ["row_key"], ["ts"], names, writer=mark)(wide, batch_id)
