"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it. Every
node has a failure link and the number of pieces that following it closes, so one pass over the bytes of a word counts
the pieces that greedy longest match would cut, without building any.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import exact, numbered, spread

#: Distinct words whose counts a task remembers, and bytes of the longest of them: a bound on its memory.
_REMEMBERED, _BRIEF = 300_000, 100


class LongestMatch(dict):
    """Word (bytes) -> number of pieces; remembers what it has counted. A word that cannot be cut counts as one piece."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes], prefix: bytes = b""):
        """prefix is put before each word that is looked up."""
        super().__init__()
        self._prefix = prefix
        self._next: dict[int, int] = {}
        ends, nodes = set(), 2
        parent_of: list[tuple[int, int]] = [(0, 0), (1, 0)]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for byte in piece:
                    key = at << 8 | byte
                    if key not in self._next:
                        self._next[key] = nodes
                        parent_of.append((at, byte))
                        nodes += 1
                    at = self._next[key]
                if at > 1:
                    ends.add(at)
        children: list[list[int]] = [[] for _ in range(nodes)]
        for node in range(2, nodes):
            children[parent_of[node][0]].append(node)
        self._fail, self._pops = [-1] * nodes, [0] * nodes
        queue = deque(children[0] + children[1])
        while queue:
            node = queue.popleft()
            queue.extend(children[node])
            if node in ends:
                self._fail[node], self._pops[node] = 1, 1
                continue
            up, byte = parent_of[node]
            at, pops = self._fail[up], self._pops[up]
            while at >= 0 and (at << 8 | byte) not in self._next:
                pops += self._pops[at]
                at = self._fail[at]
            if at >= 0:
                self._fail[node], self._pops[node] = self._next[at << 8 | byte], pops

    def count(self, word: bytes) -> int:
        step, fail, pops = self._next.get, self._fail, self._pops
        at, n = 0, 0
        for byte in word:
            while (to := step(at << 8 | byte)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        n = self.count(self._prefix + word)
        if len(word) <= _BRIEF:
            self[word] = n
        return n


def from_rank_file(path: str) -> LongestMatch:
    """Pieces of a byte-level rank file: those with a leading space begin a word, those without continue it.

    The words are looked up without the space; single bytes are pieces, so every word can be cut once begun by the bare
    space, which then is a piece of its own.
    """
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return LongestMatch([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "], b" ")


_loaded: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row: words are runs without ASCII white space, each cut by longest match.

    Null and empty texts have no words. Null ids, repeated rows and ties need no care: rows stand alone. Other columns
    are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _loaded:
            _loaded[path] = from_rank_file(path)
        lengths = _loaded[path]
        for pdf in batches:
            words = [_words(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(lengths.__getitem__, w)) for w in words]})

    rows = docs.select(exact(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return numbered(spread(rows).mapInPandas(run, "doc_id string, n_words long, n_tokens long"))


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if isinstance(text, str) else []
