"""Small helpers that the operators share: tables, shared storage, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Without one a local session takes a temporary folder;
    on a cluster that would be another one on each machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: later jobs start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._stored_at = path
    return rows


def placed(df: DataFrame, column: str) -> DataFrame:
    """stored(), dealt by a column into as many buckets as there are shuffle partitions, so that joins on it need not move
    these rows. The table's name leaves the catalog at once, its files stay in the shared folder."""
    spark = df.sparkSession
    name = f"rows_{uuid.uuid4().hex}"
    df.write.bucketBy(many(spark), column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"drop table {name}")
    return rows


def keyed(df: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """_k (unique long) and the columns `keep`. The key is the id where it is unique and never null; otherwise a number in
    the order of ids (null ones last, rows of one id by a hash) that is given once to the stored rows, so that repeated
    rows and null ids stay apart."""
    ids = df.select(F.col(id_col).cast("long").alias("_k"))
    odd = ids.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _k is null").limit(1).count()
    if not odd:
        return df.select(F.col(id_col).cast("long").alias("_k"), *keep)
    rows = df.sort(F.asc_nulls_last(F.col(id_col).cast("long")), F.xxhash64(*keep))
    return stored(rows.select(F.monotonically_increasing_id().alias("_k"), *keep))


def spread(df: DataFrame) -> DataFrame:
    """Deals out rows that are read in fewer partitions than there are cores, which would leave most of them idle; frames
    that shuffle rows stay as they are. Rows and their values stay the same, in another order."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().toString().startswith("Adaptive"):
        return df
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def exact(id_col: str) -> Column:
    """An id as text: pandas would turn numbers beside nulls into floats."""
    return F.col(id_col).cast("long").cast("string")


def numbered(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """exact() undone."""
    return df.withColumn(column, F.col(column).cast("long"))


def many(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
