"""Packing of documents into training sequences: first-fit decreasing with a tournament tree of bin capacities, run
independently in randomised groups of documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import exact, numbered, spread, stored

LENGTH, END = 2048, 1
#: Documents of a group on average: enough to fill bins well, and few enough for any task.
GROUP = 4096
#: Distinct words whose ids a task remembers, and characters of the longest of them: a bound on its memory.
_REMEMBERED, _BRIEF = 250_000, 100
#: Fixed value: the pattern in the tokenizer file that cuts lower-case text into words.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin-1 characters on which Python and the tokenizer might disagree about white space.
_UNSURE = re.compile(rb"[\x1c-\x1f\x85]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Lower-case word without white space -> its ids as little-endian unsigned 32-bit numbers.

    Texts of Latin-1 characters are in normal form already and split at white space; each distinct word then goes to the
    tokenizer's model once. All other texts go to the tokenizer whole, and with `added` also those that hold an added
    token like <|endoftext|>, which is then that token, as the tokenizer has it by default; else it is text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = not added
        literals = [t.content.lower() for t in self._whole.get_added_tokens_decoder().values()] if added else []
        self._added = re.compile("|".join(map(re.escape, literals))) if literals else None
        self._model = self._whole.model
        self._letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            if len(self._pieces) >= _REMEMBERED:
                self._pieces.clear()
            spelled = piece.encode().decode("latin-1").translate(self._letters)
            ids = np.array([t.id for t in self._model.tokenize(spelled)], "<u4").tobytes()
            if len(piece) <= _BRIEF:
                self._pieces[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        ids = b"".join(map(self._piece, _PIECES.findall(word)))
        if len(word) <= _BRIEF:
            self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not isinstance(text, str) or not text:
            return b""
        try:
            plain = not _UNSURE.search(text.encode("latin-1"))
        except UnicodeEncodeError:
            plain = False
        low = text.lower() if plain else ""
        if plain and not (self._added and self._added.search(low)):
            return b"".join(map(self.__getitem__, low.split()))
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[tuple[str, bool], Ids] = {}


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id, cut at every `length` ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path, added) not in _loaded:
            _loaded[path, added] = Ids(path, added)
        ids, last = _loaded[path, added], np.array([end], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = ids.of(text) + last
                n = len(raw) // 4
                out += [(doc_id, at, min(length, n - at), zlib.crc32(raw[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(exact("doc_id").alias("doc_id"), "text")
    return spread(rows).mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long")


class Tournament:
    """Capacities of bins as the leaves of a tree whose nodes hold the larger of two; finds the first bin that fits."""

    def __init__(self, bins: int, capacity: int):
        self._leaves = 1 << max(0, bins - 1).bit_length()
        self._room = [capacity] * (2 * self._leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for the size, which is taken, and the room that it had."""
        room, at = self._room, 1
        while at < self._leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        bin_ = at - self._leaves
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return bin_, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; larger ones go first, ties in the given order."""
    tree, out = Tournament(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, room = tree.place(sizes[i])
        out[i] = (bin_, capacity - room)
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, seed: int = 7, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    A null text counts as empty, so that its document is the end id alone. Null ids and repeated rows are packed like
    others. Groups are drawn at random by the place of a row in the stored table, so no key can fill one. With
    `added`, as the queries have it, added tokens in a text are tokens (see Ids). Other columns are not looked at; an empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    cut = stored(pieces(docs, path, length, added=added))
    full = cut.where(F.col("length") == length)
    rest = cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    drawn = rest.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_tokens", "ids_crc32", "start"], kind="stable").reset_index(drop=True)
        put = first_fit_decreasing(pdf["length"].tolist(), length)
        g = int(pdf["g"].iloc[0])
        return pdf.drop(columns="g").assign(sequence_id=[g << 32 | b for b, _ in put], offset=[o for _, o in put])

    kind = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    filled = drawn.groupBy("g").applyInPandas(fill, kind)
    alone = full.withColumn("sequence_id", F.lit(1 << 62).bitwiseOR(F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))
    return numbered(filled.unionByName(alone))
