"""Substring dedup over words: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into
maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import spread
from tidemark.llm.hashing import rolling, word_hashes
from tidemark.llm.repeats import Names, ask, bits, covered, each_piece, heard, pieces, texts_of, with_answers

WINDOW = 35
#: Bytes of text for a word, by which the number of buckets is chosen.
_WORD_BYTES = 6


class Windows:
    """All windows of a piece's texts: `bounds` are the numbers of each text's first word and the end, `starts` the first
    words of the windows that lie in one text, `places` where each word begins in `raw`."""

    def __init__(self, texts: list[bytes], window: int):
        self.raw = b"\n".join(texts)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        items, self.places = word_hashes(self.raw)
        self.bounds, self.window = np.searchsorted(self.places, at), window
        one, two = rolling(items, window)
        left = np.repeat(self.bounds[1:], np.diff(self.bounds))[: len(one)] - np.arange(len(one))
        self.starts = np.flatnonzero(left >= window)
        self.names = Names(one[self.starts], two[self.starts])

    def gone(self, answers: list[dict] | None, lead: int) -> np.ndarray:
        """Which words lie in a window that occurs again."""
        again = self.starts[heard(self.names.sort(lead), answers, "again")]
        return covered(again, again + self.window, len(self.places))


def _apply(docs: DataFrame, columns: list[str], window: int, result: Callable, kind: str) -> DataFrame:
    """result(text, words gone, columns...) of every row."""
    rows = pieces(spread(docs), columns)
    lead = bits(rows, _WORD_BYTES)
    answers = ask(rows, lead, lambda texts: Windows(texts, window).names)
    fields = [x.split() for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, (said,) in each_piece(batches, ("said",)):
            texts = texts_of(part)
            found = Windows(texts, window)
            gone, ends = found.gone(said, lead), found.bounds.tolist()
            more = zip(*[part.field(c).to_pylist() for c in columns], strict=True)
            out = [result(t, gone[a:b], *x) for t, a, b, x in zip(texts, ends[:-1], ends[1:], more, strict=True)]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    return with_answers(rows, {"said": answers}).mapInArrow(run, kind)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    A word goes if some window of `window` words that covers it also starts anywhere else. Null texts have no words;
    texts shorter than a window lose none. Rows that repeat an id or have none count as documents of their own. Other
    columns are not looked at; an empty table gives no rows.
    """

    def result(text: bytes, gone: np.ndarray, doc_id: int | None) -> tuple:
        n = int(gone.sum())
        words = text.split()
        kept = compress(words, (~gone).tolist()) if n else words
        return doc_id, len(gone), n, hashlib.sha256(b" ".join(kept)).hexdigest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _apply(rows, ["doc_id"], window, result, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: bytes, gone: np.ndarray) -> str:
    """The text as it is where no word goes; else its kept runs of words with the white space inside them, one space
    between runs."""
    if not gone.any():
        return text.decode()
    begin, end, at, out = [], [], 0, []
    for word in text.split():
        at = text.index(word, at)
        begin.append(at)
        at += len(word)
        end.append(at)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    for low, high in edge.reshape(-1, 2).tolist():
        out.append(text[begin[low] : end[high - 1]])
    return b" ".join(out).decode()


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source) with the words that digests() removes cut out of each text.

    Every copy of a repeated passage goes, the first one too, so a text that holds nothing else becomes empty; its row
    stays. Texts that lose nothing keep their white space. Cases are as in digests(); a null text becomes an empty one.
    """
    columns = ["doc_id", "lang", "source"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return _apply(rows, columns, window, lambda text, gone, *more: (cut(text, gone), *more), "text string, doc_id long, lang string, source string")
