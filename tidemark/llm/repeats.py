"""Exact search for repeated names (hashes of windows) over all documents, in rounds that Spark sorts.

Documents are gathered to pieces of a few megabytes, stored in an order of their own. In a round each piece sends its
distinct names, sorted and packed, to buckets of the name space; a bucket sorts the names of all pieces and answers each
piece with one bit a name: whether it occurs again, and whether an earlier piece has it. A name that every document holds is
sent once a piece. Only the bits come back, so neither texts nor positions are shuffled.

Names have 72 bits beside those of the bucket, whose number grows with the data: the odds that a name meets an equal one by
chance stay at 2**-52 at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import placed, stored

#: Bytes of text in a piece, names in a bucket, about.
PIECE, BUCKET = 4 << 20, 1 << 20


def pieces(docs: DataFrame, columns: list[str], size: int = PIECE) -> DataFrame:
    """piece, bytes, docs (array of text and the columns) of all rows, stored. Pieces are numbered in the order of the
    rows' partitions and, within one, of the rows; a text longer than a piece is one of its own. Null texts are empty."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            before = np.concatenate([[0], np.cumsum(n)])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(before[:-1] // size)) + 1, [len(n)]])
            each = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)
            names = pa.array(np.arange(no, no + len(cuts) - 1))
            no += len(cuts) - 1
            yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(before[cuts])), lists], ["piece", "bytes", "docs"])

    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema)
    return placed(rows.mapInArrow(run, f"piece long, bytes long, docs array<struct<{kinds}>>"), "piece")


def bits(rows: DataFrame, per: float) -> int:
    """So many leading bits of a name say its bucket; per: bytes of text for a name."""
    names = (rows.agg(F.sum("bytes")).first()[0] or 0) / per
    return max(0, int(np.ceil(np.log2(max(1, names / BUCKET)))))


@dataclass
class Names:
    """Hashes at some positions of a piece. low and high: a further hash each, of which only the smallest and largest for a
    name are asked about (whether all are equal)."""

    one: np.ndarray
    two: np.ndarray
    other: np.ndarray | None = None

    def __post_init__(self):
        self.first = self.of = self.order = None

    def sort(self, lead: int) -> Names:
        """Finds the distinct names: `order` of positions, `first` place in it of each name, and `of`, each position's name."""
        self.rest = self.one << np.uint64(lead) | (self.two >> np.uint64(64 - lead) if lead else np.uint64(0))
        self.last = self.two.astype(np.uint8)
        self.order, self.first = ordered(self.one, self.rest, self.last)
        self.of = np.empty(len(self.one), np.int64)
        self.of[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.one))))
        return self

    def slices(self, lead: int) -> Iterator[tuple]:
        """bucket, n, names, twice and other for each bucket that the names fall in."""
        head = self.order[self.first]
        bucket = (self.one[head] >> np.uint64(64 - lead) if lead else np.zeros(len(head), np.uint64)).astype(np.int64)
        twice = np.diff(np.append(self.first, len(self.order))) > 1
        if self.other is not None and len(head):
            low, high = (op.reduceat(self.other[self.order], self.first) for op in (np.minimum, np.maximum))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(head)]]) if len(head) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            more = low[a:b].tobytes() + high[a:b].tobytes() if self.other is not None else b""
            yield int(bucket[a]), int(b - a), self.rest[head[a:b]].tobytes() + self.last[head[a:b]].tobytes(), np.packbits(twice[a:b]).tobytes(), more

    def firsts(self) -> np.ndarray:
        """For each position whether it is the first of its name in the piece."""
        out = np.zeros(len(self.one), bool)
        if len(self.first):
            out[np.minimum.reduceat(self.order, self.first)] = True
        return out


def ordered(one: np.ndarray, rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of names, and where in it a name other than the one before stands."""
    order = np.argsort(one)
    same = one[order][1:] == one[order][:-1]
    alike = same & (rest[order][1:] == rest[order][:-1]) & (last[order][1:] == last[order][:-1])
    if (same & ~alike).any():
        order = np.lexsort((last, rest, one))
        alike = (one[order][1:] == one[order][:-1]) & (rest[order][1:] == rest[order][:-1]) & (last[order][1:] == last[order][:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(one)), bool), ~alike]))


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The bits for each piece's names in one bucket."""
    n = pdf["n"].to_numpy()
    rest = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(pdf["names"], n, strict=True)])
    last = np.concatenate([np.frombuffer(x, np.uint8, k, 8 * k) for x, k in zip(pdf["names"], n, strict=True)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(pdf["twice"], n, strict=True)]) > 0
    order, first = ordered(rest, rest, last)
    size = np.diff(np.append(first, len(order)))
    piece = np.repeat(pdf["piece"].to_numpy(), n)
    again, later, unlike = np.empty(len(order), bool), np.empty(len(order), bool), np.zeros(len(order), bool)
    again[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], first), size)
    later[order] = piece[order] != np.repeat(np.minimum.reduceat(piece[order], first), size)
    if len(pdf["other"].iloc[0]):
        low = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(pdf["other"], n, strict=True)])
        high = np.concatenate([np.frombuffer(x, np.uint64, k, 8 * k) for x, k in zip(pdf["other"], n, strict=True)])
        unlike[order] = np.repeat(np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first), size)
    ends = np.cumsum(n)
    packed = [[np.packbits(flags[e - k : e]).tobytes() for e, k in zip(ends, n, strict=True)] for flags in (again, later, unlike)]
    return pdf[["piece", "bucket", "n"]].assign(again=packed[0], later=packed[1], unlike=packed[2])


def heard(names: Names, answers: list[dict] | None, flag: str) -> np.ndarray:
    """For each position of sorted names one of the answers: `again`, it occurs elsewhere too; `later`, an earlier piece has
    it; `unlike`, its other hashes are not all equal."""
    rows = sorted(answers if answers is not None else [], key=lambda r: r["bucket"])
    said = [np.unpackbits(np.frombuffer(r[flag], np.uint8), count=r["n"]) for r in rows]
    return (np.concatenate([np.empty(0, np.uint8), *said]) > 0)[names.of]


def texts_of(docs: pa.Array) -> list[bytes]:
    return docs.field("text").cast(pa.binary()).to_pylist()


def each_piece(batches: Iterator[pa.RecordBatch], labels: tuple[str, ...]) -> Iterator[tuple[int, pa.StructArray, list]]:
    for batch in batches:
        docs = batch.column("docs")
        for i in range(batch.num_rows):
            start, end = docs.offsets[i].as_py(), docs.offsets[i + 1].as_py()
            yield batch.column("piece")[i].as_py(), docs.values.slice(start, end - start), [batch.column(x)[i].as_py() for x in labels]


def with_answers(rows: DataFrame, answers: dict[str, DataFrame]) -> DataFrame:
    """Pieces with what they heard in former rounds. The pieces are stored by their number, so only answers are moved."""
    for label, each in answers.items():
        listed = each.groupBy("piece").agg(F.collect_list(F.struct("bucket", "n", "again", "later", "unlike")).alias(label))
        rows = rows.join(listed, "piece", "left")
    return rows


def ask(rows: DataFrame, lead: int, find: Callable[..., Names], answers: dict[str, DataFrame] | None = None) -> DataFrame:
    """One round, stored: piece, bucket, n, again, later, unlike. find(texts, *former answers) gives a piece's names."""
    answers = answers or {}
    labels = tuple(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, docs, former in each_piece(batches, labels):
            names = find(texts_of(docs), *former).sort(lead)
            out = [(bucket, piece, *rest) for bucket, *rest in names.slices(lead)]
            if out:
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2].cast(pa.int32()), *[c.cast(pa.binary()) for c in columns[3:]]], ["bucket", "piece", "n", "names", "twice", "other"])

    sent = with_answers(rows, answers).mapInArrow(run, "bucket long, piece long, n int, names binary, twice binary, other binary")
    kind = "piece long, bucket long, n int, again binary, later binary, unlike binary"
    return stored(sent.groupBy("bucket").applyInPandas(_judge, kind))


def in_order(docs: DataFrame, id_col: str) -> DataFrame:
    """Rows dealt and sorted by id, null ones last, those of one id by their text."""
    from tidemark.llm.frames import many

    order: list[Column] = [F.asc_nulls_last(F.col(id_col).cast("long")), F.xxhash64("text").asc(), F.monotonically_increasing_id().asc()]
    return docs.repartitionByRange(many(docs.sparkSession), *order).sortWithinPartitions(*order[:2])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in some stretch [start, end)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
