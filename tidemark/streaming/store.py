"""Keyed tables that micro-batches change: immutable parts, and a manifest that names those in force.

A batch writes its own rows as one new part, and then a manifest that lists it: the change is there as a whole or not at all, and
readers keep the version with which they began. What a batch writes follows its own size: parts are put together only where the
last ones have grown as large as the one before them, so that a row is written again about as often as the table has doubled.
A part holds one row a key, and rows of several parts are merged by maxima, so that the order in which batches come, and batches
that come again, change nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions whose files stay, for those who still read them.
KEPT = 3


@dataclass(frozen=True)
class Part:
    path: str
    rows: int


@dataclass(frozen=True)
class Manifest:
    """What a table is: of kind `rows` (the last row of each key) or `changes` (the last value of each column)."""

    kind: str
    keys: list[str]
    order: list[str]
    columns: list[str]
    version: int = 0
    dropped: bool = False
    schema: str | None = None
    since: int = -1
    parts: list[Part] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


def _versions(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in _names(spark, f"{path}/_versions") if n.endswith(".json"))


def _load(spark: SparkSession, path: str, name: str) -> Manifest:
    fs, place = _fs(spark, f"{path}/_versions/{name}")
    stream = fs.open(place)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(**found | {"parts": [Part(**p) for p in found["parts"]]})


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The version in force; none if there never was a table."""
    versions = _versions(spark, path)
    return _load(spark, path, versions[-1]) if versions else None


def _switch(spark: SparkSession, path: str, new: Manifest) -> None:
    """Puts a version in force, in one step: its file takes its name only when it is whole. Needs a file system that renames in
    one step."""
    name = f"{path}/_versions/{new.version:012d}.json"
    fs, place = _fs(spark, name)
    _, temporary = _fs(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(temporary, place):
        fs.delete(temporary, False)
        raise Conflict(f"version {new.version} of {path}")
    _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes versions that are KEPT behind, and the parts that only they name. Parts that no version names, as writers that are at
    work or were killed leave them, stay."""
    versions = _versions(spark, path)
    parts = lambda names: {p.path for n in names for p in _load(spark, path, n).parts}
    for part in parts(versions[:-KEPT]) - parts(versions[-KEPT:]):
        delete(spark, f"{path}/{part}")
    for name in versions[:-KEPT]:
        delete(spark, f"{path}/_versions/{name}")


def create(spark: SparkSession, path: str, keys: list[str], columns: list[str], order: list[str], schema: str, kind: str = "changes", anew: bool = False, since: int = -1) -> None:
    """Makes an empty table if there is none; with `anew` also in place of one that is there, whose rows are gone with the same
    step. schema: the table's columns in DDL."""
    now = manifest(spark, path)
    if now is None or now.dropped or anew:
        _switch(spark, path, Manifest(kind, keys, order, columns, now.version + 1 if now else 0, schema=schema, since=since, batches=now.batches if now else {}))


def drop(spark: SparkSession, path: str, since: int = -1) -> None:
    now = manifest(spark, path)
    if now is not None and not now.dropped:
        _switch(spark, path, replace(now, version=now.version + 1, dropped=True, since=since, parts=[]))


def follow(spark: SparkSession, path: str, op: str, at: int, keys: list[str], columns: list[str], order: list[str], schema: str) -> None:
    """Makes, drops or empties a table by a configuration change of that time; changes of an earlier or the same time than the last
    one are left out, so that they may come again."""
    now = manifest(spark, path)
    if now is not None and at <= now.since:
        return
    if op == "d":
        drop(spark, path, at)
    else:
        create(spark, path, keys, columns, order, schema, anew=op == "u", since=at)


def _merged(rows: DataFrame, table: Manifest) -> DataFrame:
    """One row a key. Rows: the last by the order columns. Changes: the last change, the last deletion, and of each column the
    last value that is not null with its place."""
    by = [F.col(k) for k in table.keys]
    if table.kind == "rows":
        return rows.groupBy(*by).agg(F.max("row").alias("row"))
    return rows.groupBy(*by).agg(F.max("last").alias("last"), F.max("reset").alias("reset"), *[F.max(_quoted(c)).alias(c) for c in table.columns])


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _folded(batch: DataFrame, table: Manifest) -> DataFrame:
    """The rows of a batch in the form of a part."""
    at = F.struct(*[_quoted(o) for o in table.order])
    if table.kind == "rows":
        rest = [_quoted(c) for c in batch.columns if c not in (*table.keys, *table.order)]
        return batch.select(*table.keys, F.struct(*[_quoted(o) for o in table.order], F.struct(F.lit(True).alias("_"), *rest).alias("rest")).alias("row"))
    gone = F.coalesce(F.col("type") == "delete", F.lit(False))
    value = lambda c: F.when(~gone & _quoted(c).isNotNull(), F.struct(at.alias("at"), _quoted(c).alias("value")))
    return batch.select(*table.keys, F.struct(at.alias("at"), gone.alias("gone")).alias("last"), F.when(gone, at).alias("reset"), *[value(c).alias(c) for c in table.columns])


def _write(rows: DataFrame, path: str, table: Manifest, files: int | None) -> Part:
    part = f"parts/{uuid.uuid4().hex}"
    merged = _merged(rows, table)
    (merged.coalesce(files) if files else merged).write.parquet(f"{path}/{part}")
    return Part(part, rows.sparkSession.read.schema(merged.schema).parquet(f"{path}/{part}").count())


def commit(batch: DataFrame, path: str, table: Manifest, writer: str, batch_id: int, files: int | None = None, tries: int = 5) -> None:
    """Adds a batch to the table, which is made if there is none. A batch that the same writer has added before is left out, and
    so is one for a table that was dropped. A restart finds the table as it was before the batch, or as it is after it. Where
    another writer has changed the table meanwhile, the part is added to what there is now."""
    spark = batch.sparkSession
    own: Part | None = None
    rows = _folded(batch, table)
    while True:
        now = manifest(spark, path)
        if now is not None and (now.dropped or now.batches.get(writer, -1) >= batch_id):
            return
        now = now or replace(table, version=-1)
        own = own or _write(rows, path, table, files)
        parts, between = [*now.parts, own], []
        while len(parts) > 1 and parts[-2].rows <= 2 * parts[-1].rows:
            between += [p for p in parts[-2:] if p not in now.parts and p != own]
            parts = [*parts[:-2], _write(_read_parts(spark, path, parts[-2:], rows), path, table, files)]
        try:
            _switch(spark, path, replace(now, version=now.version + 1, columns=table.columns, parts=parts, batches=now.batches | {writer: batch_id}))
        except Conflict:
            tries -= 1
            if not tries:
                raise
            between += [p for p in parts if p not in now.parts and p != own]
            continue
        finally:
            for part in between:
                delete(spark, f"{path}/{part.path}")
        if own not in parts:
            delete(spark, f"{path}/{own.path}")
        return


def _read_parts(spark: SparkSession, path: str, parts: list[Part], like: DataFrame | None = None) -> DataFrame:
    places = [f"{path}/{p.path}" for p in parts]
    if like is None:
        return spark.read.option("mergeSchema", "true").parquet(*places)
    return spark.read.schema(like.schema).parquet(*places)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that is in force now; later changes do not show. A table that was dropped cannot be read."""
    table = manifest(spark, path)
    if table is None or table.dropped:
        raise FileNotFoundError(f"no table at {path}")
    if not table.parts:
        return spark.createDataFrame([], table.schema)
    rows = _merged(_read_parts(spark, path, table.parts), table) if len(table.parts) > 1 else _read_parts(spark, path, table.parts)
    keys = [F.col(k) for k in table.keys]
    if table.kind == "rows":
        rest = [f.name for f in rows.schema["row"].dataType["rest"].dataType.fields if f.name != "_"]
        return rows.select(*keys, *[F.col("row")[o].alias(o) for o in table.order if o not in table.keys], *[F.col("row")["rest"][c].alias(c) for c in rest])
    live = rows.where("not last.gone")
    kept = lambda c: F.when(F.col("reset").isNull() | (_quoted(c)["at"] > F.col("reset")), _quoted(c)["value"]).alias(c)
    return live.select(*keys, *[F.col("last.at")[o].alias(o) for o in table.order], *[kept(c) for c in table.columns])

