"""Streaming forms of the keyed states. Rows of a key are met in event order within a batch, nulls first; a state keeps what
the batch form finds in earlier rows. All run in event-time mode, so windows may follow, unless they are asked not to.

A state that stops to matter at some time has a timer and is cleared once the watermark has passed it. States may begin with what
earlier rows, which the stream does not see, would have left behind (`history`)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, FloatType, LongType, StringType, StructField, StructType

DAY_MS = 86_400_000
#: Event time in epoch milliseconds, which states with a timer need beside the rows.
MS = "_ms"


class _Ordered(StatefulProcessor):
    """Calls step() for each row of a key in order and keeps one state row. Of a state with `until`, a time in milliseconds that
    the last field of the state tells, there is always one timer, at that time or earlier."""

    def __init__(self, schema: StructType, order: list[str], state: StructType, until: bool = False):
        self._schema, self._order, self._kind, self._until = schema, order, state, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("last", self._kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        before = last = self._state.get() if self._state.exists() else None
        for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self._order)):
            out, last = self.step(row, last)
            if out is not None:
                yield Row(**{c: out[c] for c in self._schema.names})
        if last is not None:
            self._state.update(tuple(last))
            if self._until and before is None:
                self._handle.registerTimer(last[-1])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self._state.exists():
            until = self._state.get()[-1]  # the last field of the state
            if until > expiredTimerInfo.getExpiryTimeInMs():
                self._handle.registerTimer(until)
            else:
                self._state.clear()
        return iter(())

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        last = tuple(initialState[c] for c in self._kind.names)
        self._state.update(last)
        if self._until:
            self._handle.registerTimer(last[-1])

    def step(self, row: Row, last: tuple | None) -> tuple[dict | None, tuple | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class FirstOfDay(_Ordered):
    """Rows whose day differs from the stored one (or all rows), with that day as last_day. A state that `expires` is cleared a
    day after its day has ended, whatever the time zone: later rows are of another day anyway, but then have no last_day."""

    def __init__(self, schema: StructType, order: list[str], ts: str, every: bool, expires: bool = False):
        fields = [StructField("day", DateType()), *([StructField("until", LongType())] if expires else [])]
        super().__init__(schema, order, StructType(fields), expires)
        self._ts, self._every = ts, every

    def step(self, row, last):
        day, before = row[self._ts].date(), last[0] if last else None
        out = row.asDict() | {"last_day": before} if self._every or day != before else None
        return out, (day, (row[MS] // DAY_MS + 2) * DAY_MS) if self._until else (day,)


class Deltas(_Ordered):
    """Measures less those stored, or in full where the stored row is more than max_gap whole seconds older; nulls are zero. With
    max_gap a state is cleared when it would no longer count."""

    def __init__(self, schema: StructType, order: list[str], measures: list[str], ts: str | None, max_gap: int | None):
        fields = [StructField(m, schema[m].dataType) for m in measures]
        if max_gap is not None:
            fields.append(StructField("until", LongType()))
        super().__init__(schema, order, StructType(fields), max_gap is not None)
        self._measures, self._gap = measures, max_gap
        self._zero = {m: Decimal(0) if isinstance(schema[m].dataType, DecimalType) else 0.0 if isinstance(schema[m].dataType, (DoubleType, FloatType)) else 0 for m in measures}

    def step(self, row, last):
        if last and self._gap is not None and row[MS] >= last[-1]:
            last = None
        now = tuple(self._zero[m] if row[m] is None else row[m] for m in self._measures)
        less = {m: v - (last[i] if last and last[i] is not None else 0) for i, (m, v) in enumerate(zip(self._measures, now, strict=True))}
        return row.asDict() | less, (*now, row[MS] + 1000 * (self._gap + 1)) if self._gap is not None else now


class RepairedVisitors(_Ordered):
    """The flag '1' becomes '0' where the visitor was there on an earlier day."""

    def __init__(self, schema: StructType, order: list[str], ts: str, flag: str):
        super().__init__(schema, order, StructType([StructField("first", DateType())]))
        self._ts, self._flag = ts, flag

    def step(self, row, last):
        day, new = row[self._ts].date(), row[self._flag] == "1"
        first = last[0] if last else (day if new else day - timedelta(days=1))
        return row.asDict() | ({self._flag: "0"} if new and first < day else {}), (first,)


class Corrected(StatefulProcessor):
    """A left join that is corrected: the main row of a key goes out as soon as it is there, with null for sides that are not, and
    again under the next `version` when a batch brings one of them. `within` milliseconds after the last row a key is forgotten."""

    def __init__(self, main: list[str], sides: dict[str, list[str]], state: StructType, within: int):
        self._main, self._sides, self._kind, self._within = main, sides, state, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("parts", self._kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        before = dict(zip(self._kind.names, self._state.get(), strict=True)) if self._state.exists() else None
        now = before.copy() if before else dict.fromkeys(self._kind.names) | {"version": 0, "until": 0, "_there": False}
        for row in sorted(rows, key=lambda r: (r["_side"], r[MS])):
            taken = self._sides.get(row["_side"], self._main)
            now |= {c: row[c] for c in taken} | {"until": max(now["until"], row[MS] + self._within)}
            now["_there"] = now["_there"] or row["_side"] not in self._sides
        changed = before is None or any(now[c] != before[c] for c in (*self._main, *[c for s in self._sides.values() for c in s]))
        if now["_there"] and changed:
            now["version"] += 1
            yield Row(**{c: now[c] for c in self._kind.names if c not in ("_there", "until")})
        self._state.update(tuple(now[c] for c in self._kind.names))
        if before is None:
            self._handle.registerTimer(now["until"])

    handleExpiredTimer = _Ordered.handleExpiredTimer

    def close(self) -> None:
        pass


def corrected(main: DataFrame, sides: dict[str, DataFrame], key: str, ts: str, within: int) -> DataFrame:
    """The main rows with the columns of each side, and `version`; main and sides have the key and ts. The last version of a key
    is what a left join of all rows gives, if no key comes twice on a side; at most `within` seconds lie between the rows of a key."""
    own = [c for c in main.columns if c != key]
    more = {name: [c for c in side.columns if c not in (key, ts)] for name, side in sides.items()}
    rows = main.withColumn("_side", F.lit(""))
    for name, side in sides.items():
        rows = rows.unionByName(side.withColumn("_side", F.lit(name)), allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    names = [key, *own, *[c for cs in more.values() for c in cs]]
    fields = [StructField(c, kinds[c]) for c in names] + [StructField("version", LongType())]
    state = StructType([*fields, StructField("_there", BooleanType()), StructField("until", LongType())])
    processor = Corrected([key, *own], {n: [key, *cs] for n, cs in more.items()}, state, 1000 * within)
    rows = rows.withColumn(MS, F.unix_millis(ts))
    return rows.groupBy(key).transformWithState(processor, StructType(fields), "Append", "EventTime", None, ts)


def _run(rows: DataFrame, keys: list[str], processor: _Ordered, schema: StructType, ts: str | None, began: DataFrame | None = None) -> DataFrame:
    """began: the keys and the fields of the state for keys with a history."""
    initial = began.groupBy(*keys) if began is not None else None
    if ts is None:
        return rows.groupBy(*keys).transformWithState(processor, schema, "Append", "None", initial)
    if processor._until:
        rows = rows.withColumn(MS, F.unix_millis(ts))
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime", initial, ts)


def first_of_day(rows: DataFrame, keys: list[str], ts: str, order: list[str], every: bool = False, expires: bool = False, history: DataFrame | None = None) -> DataFrame:
    schema = StructType([*rows.schema.fields, StructField("last_day", DateType())])
    began = None
    if history is not None:
        last = F.max(ts).alias("_last")
        began = history.groupBy(*keys).agg(last).where("_last is not null").select(*keys, F.to_date("_last").alias("day"), ((F.floor(F.unix_millis("_last") / DAY_MS) + 2) * DAY_MS).alias("until"))
        began = began if expires else began.drop("until")
    return _run(rows, keys, FirstOfDay(schema, order, ts, every, expires), schema, ts, began)


def deltas(rows: DataFrame, keys: list[str], measures: list[str], order: list[str], ts: str, max_gap: int | None = None, history: DataFrame | None = None) -> DataFrame:
    wide = lambda t: DecimalType(min(38, t.precision + 1), t.scale) if isinstance(t, DecimalType) else t
    schema = StructType([StructField(f.name, wide(f.dataType) if f.name in measures else f.dataType) for f in rows.schema.fields])
    processor, began = Deltas(schema, order, measures, ts, max_gap), None
    if history is not None:
        last = F.max_by(F.struct(*measures, F.unix_millis(ts).alias(MS)), F.struct(*order)).alias("last")
        values = [F.coalesce(F.col("last")[m], F.lit(0)).cast(schema[m].dataType).alias(m) for m in measures]
        until = [(F.col("last")[MS] + 1000 * (max_gap + 1)).alias("until")] if max_gap is not None else []
        began = history.groupBy(*keys).agg(last).select(*keys, *values, *until)
    return _run(rows, keys, processor, schema, ts, began)


def repaired_visitors(rows: DataFrame, visitor: str, ts: str, flag: str, order: list[str], timed: bool = True, history: DataFrame | None = None) -> DataFrame:
    fields = [StructField(f.name, StringType() if f.name == flag else f.dataType) for f in rows.schema.fields]
    began = None
    if history is not None:
        first = F.min_by(F.struct(F.to_date(ts).alias("day"), F.col(flag).alias("flag")), F.struct(*order)).alias("first")
        day = F.when(F.col("first.flag").eqNullSafe(F.lit("1")), F.col("first.day")).otherwise(F.date_sub("first.day", 1))
        began = history.groupBy(visitor).agg(first).select(visitor, day.alias("first"))
    return _run(rows, [visitor], RepairedVisitors(StructType(fields), order, ts, flag), StructType(fields), ts if timed else None, began)


def use_rocksdb(spark) -> None:
    """Keyed states need the RocksDB store, which also keeps large states off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
