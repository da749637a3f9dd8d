"""Byte-level dedup by distributed prefix doubling.

The rank of a string of 2k bytes is the pair of the ranks of its halves, so ranks of growing length come from pairs at
growing offsets, and Spark sorts the ranks with their positions' pieces between the lengths: positions whose rank is unique
leave, until a rank is unique or as long as the threshold. Two things keep it from sending every position. Ranks are hashes
of the pairs, which all pieces know without being told. And each string of the threshold's length is known by one of its
halves, chosen by content, so equal strings choose equal halves at equal offsets and only chosen halves are ranked at first:

1. Halves. A string whose chosen half occurs once occurs once.
2. Blocks. Neighbouring strings with the same chosen half are a block; the pair of the ranks of its first and its last
   string ranks the whole block. Equal blocks repeat each other string by string.
3. Strings. Where a half has several sorts of blocks, the first block of each sort is ranked string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import doubled_at, first_minima, mix
from tidemark.llm.repeats import Names, ask, bits, covered, each_piece, heard, in_order, pieces, texts_of, with_answers

LENGTH = 100
#: Positions whose order numbers are compared at once, a bound on memory; bytes of text for a chosen half, about.
_SEGMENT, _APART = 1 << 20, 24


class Blocks:
    """The blocks of a piece's texts: chosen half `at`, first and last start of its strings `low` and `high`."""

    def __init__(self, texts: list[bytes], length: int):
        self.raw, self.length, self.half = b"".join(texts), length, -(-length // 2)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        first, stop = self.bounds[:-1], np.maximum(self.bounds[1:] - length + 1, self.bounds[:-1])
        n, w = len(self.raw) - length + 1, length - self.half + 1
        edges, places, last = [], [], -1
        eight = np.ndarray((len(self.raw),), "<u8", self.raw + b"\0" * 8, strides=(1,))
        for at in range(0, n, _SEGMENT):
            to = min(n, at + _SEGMENT)
            order = (mix(eight[at : to + w - 1].copy()) >> np.uint64(32)).astype(np.uint32)
            chosen = first_minima(order, w) + at
            new = np.flatnonzero(np.concatenate([[chosen[0] != last], chosen[1:] != chosen[:-1]]))
            edges.append(new + at)
            places.append(chosen[new])
            last = chosen[-1]
        low, at = (np.concatenate([np.empty(0, np.int64), *x]) for x in (edges, places))
        # a text's first string begins a block too, and its strings end where the next text's would begin
        begin = np.setdiff1d(first[stop > first], low)
        at = np.concatenate([at, at[np.searchsorted(low, begin, "right") - 1]]) if len(begin) else at
        low = np.concatenate([low, begin])
        order = np.argsort(low, kind="stable")
        low, at = low[order], at[order]
        high = np.append(low[1:], n)[: len(low)] - 1
        of = np.searchsorted(self.bounds, low, "right") - 1
        inside = low < stop[of] if len(low) else np.zeros(0, bool)
        self.low, self.at, of = low[inside], at[inside], of[inside]
        self.high = np.minimum(high[inside], stop[of] - 1)

    def rank(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return doubled_at(self.raw, at, length)

    def halves(self) -> Names:
        return Names(*self.rank(self.at, self.half))

    def take(self, keep: np.ndarray) -> None:
        self.at, self.low, self.high = self.at[keep], self.low[keep], self.high[keep]

    def whole(self) -> Names:
        """Ranks of blocks: the pair of first and last string."""
        (a, b), (c, d) = self.rank(self.low, self.length), self.rank(self.high, self.length)
        return Names(mix(a + mix(c)), mix(mix(b) ^ d))

    def strings(self) -> tuple[np.ndarray, Names]:
        """All strings of the blocks, by their starts."""
        size = self.high - self.low + 1
        starts = np.repeat(self.low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return starts, Names(*self.rank(starts, self.length))


class Rounds:
    """What each round asks of a piece, from what it heard before."""

    def __init__(self, length: int, lead: int):
        self.length, self.lead = length, lead

    def halves(self, texts: list[bytes]) -> Names:
        return Blocks(texts, self.length).halves()

    def _left(self, texts: list[bytes], halves: list | None) -> Blocks:
        """The blocks whose chosen half occurs again."""
        blocks = Blocks(texts, self.length)
        blocks.take(heard(blocks.halves().sort(self.lead), halves, "again"))
        return blocks

    def blocks(self, texts: list[bytes], halves: list | None) -> Names:
        return self._left(texts, halves).whole()

    def sorts(self, texts: list[bytes], halves: list | None) -> Names:
        """The halves again, with the ranks of their blocks: are all blocks of a half equal?"""
        blocks = self._left(texts, halves)
        names = blocks.halves()
        names.other = blocks.whole().one
        return names

    def _firsts(self, texts: list[bytes], halves: list | None, blocks: list | None, sorts: list | None) -> tuple[Blocks, np.ndarray, np.ndarray]:
        """The blocks, which of them have an equal one before them, and which are the first of several sorts of a half."""
        left = self._left(texts, halves)
        whole = left.whole().sort(self.lead)
        later = heard(whole, blocks, "later") | ~whole.firsts()
        return left, later, ~later & heard(left.halves().sort(self.lead), sorts, "unlike")

    def strings(self, texts: list[bytes], halves: list | None, blocks: list | None, sorts: list | None) -> Names:
        left, _, first = self._firsts(texts, halves, blocks, sorts)
        left.take(first)
        return left.strings()[1]

    def gone(self, texts: list[bytes], halves: list | None, blocks: list | None, sorts: list | None, strings: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes of a piece go, and the bounds of its texts."""
        left, later, first = self._firsts(texts, halves, blocks, sorts)
        low, high = left.low[later], left.high[later] + self.length
        left.take(first)
        starts, names = left.strings()
        names.sort(self.lead)
        starts = starts[heard(names, strings, "later") | ~names.firsts()]
        return covered(np.concatenate([low, starts]), np.concatenate([high, starts + self.length]), len(left.raw)), left.bounds


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    A byte goes if some string of `length` bytes that covers it also starts earlier: in a document of smaller doc_id, or
    in the same one before. Null texts are empty; texts shorter than the length lose nothing. Rows that repeat an id or
    have none are documents of their own; those of one id follow each other, those without come last. Other columns are
    not looked at; an empty table gives no rows. The length is 16 at least.
    """
    rows = pieces(in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), ["doc_id"])
    lead = bits(rows, _APART)
    rounds = Rounds(length, lead)
    said: dict[str, DataFrame] = {}
    said["halves"] = ask(rows, lead, rounds.halves)
    more = {x: ask(rows, lead, find, said) for x, find in (("blocks", rounds.blocks), ("sorts", rounds.sorts))}
    said |= more
    said["strings"] = ask(rows, lead, rounds.strings, said)
    labels, kind = tuple(said), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, heard_ in each_piece(batches, labels):
            texts = texts_of(part)
            gone, bounds = rounds.gone(texts, *heard_)
            out = []
            for doc_id, text, at in zip(part.field("doc_id").to_pylist(), texts, bounds[:-1].tolist(), strict=True):
                flags = np.concatenate([[False], gone[at : at + len(text)], [False]])
                runs = np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2).tolist()
                kept, to = hashlib.sha256(), 0
                for low, high in runs:
                    kept.update(text[to:low])
                    to = high
                kept.update(text[to:])
                out.append((doc_id, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], [x.split()[0] for x in kind.split(", ")])

    return with_answers(rows, said).mapInArrow(run, kind)
