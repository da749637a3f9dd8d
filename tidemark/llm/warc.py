"""WARC archives: writing with revisit records, an external merge of capture indexes, and reading back.

Writers emit one index run for each archive, sorted by URL key and timestamp. Range partitions of the key space then merge
their slices of all runs with a loser tree, so the index as a whole is in order without any task holding it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keyed, many, shared_dir, stored

#: Payloads below this many bytes are never revisits. Records of an archive at most: a bound on a run's memory.
LEAST, ARCHIVE_RECORDS = 100, 20_000
_LAST = (1 << 63) - 1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: the WARC 1.1 profile of revisits with identical payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_INDEX = "run string, url_key string, timestamp string, page_id long, offset long, length long"
_MERGED = f"{_INDEX}, part long, place long"


def file_system(uri: str):
    """The file system of a folder and the path in it, usable in any task."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]+:", uri) and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, all in lower case; the text itself if it is no URL."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    labels = ",".join(reversed(host.split(".")))
    return (f"{labels})" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def captured(page_id: int | None) -> datetime:
    """Pages carry no time of capture; the number of the page, as seconds after a fixed day, stands for it."""
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 10**9)


def record_id(key: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=key % 2**64)}>"


def record(row: dict, when: datetime) -> bytes:
    """One WARC record as a gzip member of its own."""
    head = {
        "WARC-Type": "response" if row["refers_k"] is None else "revisit",
        "WARC-Record-ID": record_id(row["k"]),
        "WARC-Date": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", row["url"] or ""),
        "WARC-Payload-Digest": "sha256:" + row["digest"],
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(row["payload_bytes"]),
    }
    if row["page_id"] is not None:
        head["X-Page-Id"] = str(row["page_id"])
    block = _HTTP
    if row["refers_k"] is None:
        block += (row["html"] or "").encode()
    else:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(row["refers_k"])}
        if row["refers_to"] is not None:
            head["X-Refers-To-Page-Id"] = str(row["refers_to"])
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges k sorted lists: inner nodes keep the loser of their match, so each step replays one path to the root."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self._runs = [iter(r) for r in runs]
        self._heads = [next(r, None) for r in self._runs]
        k = len(self._runs)
        self._losers = [-1] * max(1, k)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._before(a, b) else (b, a)
        self._winner = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self._runs)
        while k and (head := self._heads[self._winner]) is not None:
            yield head
            at = self._winner
            self._heads[at] = next(self._runs[at], None)
            node = (at + k) // 2
            while node:
                if self._before(self._losers[node], at):
                    self._losers[node], at = at, self._losers[node]
                node //= 2
            self._winner = at


def _decide(pages: DataFrame) -> DataFrame:
    """_k and, of revisits, the key and page_id of the response."""
    known = pages.select("_k", "page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("digest"))
    known = stored(known)
    first = F.min(F.struct(F.coalesce("page_id", F.lit(_LAST)).alias("order"), "_k", "page_id")).alias("first")
    groups = known.where(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(first, F.count(F.lit(1)).alias("of")).where("of > 1")
    again = known.where(F.col("payload_bytes") >= LEAST).join(groups.select("digest", "first"), "digest").where("_k <> first._k")
    refers = again.select("_k", F.col("first._k").alias("refers_k"), F.col("first.page_id").alias("refers_to"))
    return known.drop("page_id").join(refers, "_k", "left")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes .warc.gz files to the folder; index rows of each archive, sorted. pages: page_id, url, html.

    Of pages of equal payload and at least 100 bytes, that with the smallest page_id (then the first stored) is written in
    full, the others as revisits of it. Files appear whole under their final name, so a repeated task is harmless. Nulls,
    repeated ids and other columns are as in round_trip(); an empty table writes nothing.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = keyed(rows, "page_id", ["page_id", "url", "html"])
    ready = rows.join(_decide(rows), "_k").withColumnRenamed("_k", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        task = TaskContext.get()
        whole = (row for batch in batches for part in _parts(batch, 500) for row in part.to_pylist())
        row, part = next(whole, None), 0
        while row is not None:
            name, offset, index = f"{task.partitionId():06d}-{part:04d}.warc.gz", 0, []
            draft = f"{root}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                while row is not None and len(index) < ARCHIVE_RECORDS:
                    when = captured(row["page_id"])
                    member = record(row, when)
                    out.write(member)
                    index.append((name, url_key(row["url"]), when.strftime("%Y%m%d%H%M%S"), row["page_id"], offset, len(member)))
                    offset += len(member)
                    row = next(whole, None)
            fs.move(draft, f"{root}/{name}")
            part += 1
            index.sort(key=lambda r: (r[1], r[2], r[4]))
            yield _batch(index, _INDEX)

    return ready.mapInArrow(run, _INDEX)


def merge_index(index: DataFrame) -> DataFrame:
    """The rows of all runs in one order of url_key, timestamp, run and offset, over parts and within them, with `part`
    (the range partition, stored as a file in order) and `capture`, the row's place in the history of its url_key, from 1.

    A range partition holds its slices of the runs in columns and merges them row by row. A key whose history spans
    partitions goes on counting: at most two keys of a partition do so, and only their counts are sent to all tasks. Ties
    of key and timestamp go by run and offset; null page_ids are carried along; no rows give none.
    """
    spark, columns = index.sparkSession, index.columns
    order = ["url_key", "timestamp", "run", "offset"]
    at = [columns.index(c) for c in order]
    slices = index.repartitionByRange(many(spark), *order).sortWithinPartitions("run", *order[:2], "offset")

    def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in parts:
            for part in _parts(batch, 1000):
                for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    yield tuple(row[i] for i in at), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            ends = pc.run_end_encode(batch.column("run"))
            low = 0
            for name, high in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                runs.setdefault(name, []).append(batch.slice(low, high - low))
                low = high
        part, url, place, out = TaskContext.get().partitionId(), None, 0, []
        for (key, *_), row in LoserTree(rows(r) for r in runs.values()):
            url, place = key, place + 1 if key == url else 1
            out.append((*row, part, place))
            if len(out) == 10_000:
                yield _batch(out, _MERGED)
                out = []
        if out:
            yield _batch(out, _MERGED)

    merged = stored(slices.mapInArrow(run, _MERGED))
    sizes = merged.groupBy("url_key", "part").agg(F.count(F.lit(1)).alias("n"))
    spread_ = sizes.groupBy("url_key").agg(F.collect_list(F.struct("part", "n")).alias("parts")).where("size(parts) > 1")
    before = F.expr("aggregate(filter(parts, q -> q.part < p.part), 0L, (a, q) -> a + q.n)").alias("before")
    spread_ = spread_.select("url_key", "parts", F.explode("parts").alias("p")).select("url_key", F.col("p.part").alias("part"), before)
    told = merged.join(F.broadcast(spread_), ["url_key", "part"], "left")
    return told.select(*columns, "part", (F.col("place") + F.coalesce("before", F.lit(0))).alias("capture"))


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    fields = [pa.field(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in kind.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, timestamp, capture of every row of a merged
    index, from the record in its archive. Sizes and digests of responses are computed anew and held against the record's
    headers; a revisit has no payload of its own, and its size and digest are those that its record states."""

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string, capture long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["run"] != name:
                    if file:
                        file.close()
                    name, file = row["run"], fs.open_input_file(f"{root}/{row['run']}")
                headers, payload = parse(file.read_at(row["length"], row["offset"]))
                digest, size, sort = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"]), headers["WARC-Type"]
                if sort == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"{name} at {row['offset']}: the payload is not what its record says")
                number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                out.append((number("X-Page-Id"), size, digest, sort, number("X-Refers-To-Page-Id"), row["url_key"], row["timestamp"], row["capture"]))
            yield _batch(out, kind)
        if file:
            file.close()

    near = index.repartition(many(index.sparkSession), "run").sortWithinPartitions("run", "offset")
    return near.mapInArrow(run, kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives to the shared folder, merges the index runs, and reads every record back.

    One row a page, with its place in the captures of its URL. Null html is an empty payload; null urls have the key of an empty one; null page_ids stay null and are
    the last choice for a response; pages that repeat an id are records of their own. Other columns are not looked at; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    runs = stored(write_archives(pages, folder))
    return read_archives(merge_index(runs), folder)
