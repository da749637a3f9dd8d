"""Keywords by dictionary, for scripts that are written without spaces.

Text in letters with spaces between them is taken word by word. A run of the other scripts is a lattice: every dictionary word that
stands in it is an edge, and every single character is one too. The keywords are the words of the best path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import col

#: Scripts whose words are not set apart.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: Words that a dictionary may hold; it is sent to all tasks.
MOST = 2_000_000


class Lexicon:
    """Dictionary words as a trie: every beginning of a word, with whether it is one."""

    def __init__(self, words: Iterable[str], unspaced: str = UNSPACED):
        self._begins: dict[str, bool] = {}
        for word in words:
            word = word.lower()
            for n in range(1, len(word)):
                self._begins.setdefault(word[:n], False)
            if word:
                self._begins[word] = True
        self._run = regex.compile(rf"(?P<run>[{unspaced}]+)|[[\p{{L}}\p{{M}}\p{{N}}_]--[{unspaced}]]+", regex.V1)

    def ends(self, run: str, start: int) -> list[int]:
        """Where the dictionary words end that begin here, the shortest first."""
        out, end = [], start + 1
        while end <= len(run) and (word := self._begins.get(run[start:end])) is not None:
            if word:
                out.append(end)
            end += 1
        return out

    def path(self, run: str) -> list[str]:
        """The words of the path that leaves the fewest characters outside of dictionary words; then of the fewest words, then of
        the most even lengths, then with the longer words later, then with the shorter last word, also of any part up to a word's end."""
        best: list[tuple[int, int, int, int] | None] = [None] * (len(run) + 1)
        came = [0] * (len(run) + 1)
        best[0] = (0, 0, 0, 0)
        for i in range(len(run)):
            outside, words, squares, place = best[i]
            ends = self.ends(run, i)
            for j, out in [(j, 0) for j in ends] + ([] if i + 1 in ends else [(i + 1, 1)]):
                now = (outside + out, words + 1, squares + (j - i) ** 2, place - words * (j - i))
                if best[j] is None or now <= best[j]:
                    best[j], came[j] = now, i
        out, j = [], len(run)
        while j:
            out.append(run[came[j] : j])
            j = came[j]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        out: list[str] = []
        for found in self._run.finditer(text.lower()):
            out += self.path(found.group()) if found["run"] else [found.group()]
        return out


def segmenter(spark: SparkSession, dictionary: DataFrame, word: str = "word", most: int = MOST, unspaced: str = UNSPACED) -> Callable[[str | Column], Column]:
    """A splitter for keywords(): text to the array of its words, null to null. The dictionary is sent to all tasks, so one of
    more than `most` words is refused; null and repeated words are left out."""
    words = [r[0] for r in dictionary.select(word).where(F.col(word).isNotNull()).distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"a dictionary may hold {most} words")
    lexicon = spark.sparkContext.broadcast(Lexicon(words, unspaced))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: lexicon.value.words(t) if isinstance(t, str) else None)

    return lambda text: split(col(text))
