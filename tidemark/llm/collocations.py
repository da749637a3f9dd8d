"""Phrase collocations, counted over a prefix-free parse of the corpus.

Each text is cut into chunks where two words in a row have a hash that is divisible by TRIGGER, so the places depend on the words
alone and passages that recur give the same chunks wherever they stand. A chunk runs on for two words beyond its end: these are
the beginning of the next one. Spark counts the chunks; phrases are counted inside each different chunk once, times its
frequency, and belong to the chunk in which they begin before those two words, so that no occurrence is counted twice.

A phrase with `least` occurrences consists of shorter ones that have as many, so words are counted first, then pairs of
frequent words, then triples of frequent pairs. Which are frequent is told by a bitmap of bounded size: where it errs, a
phrase is counted that would not have had to be; no count depends on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import many, spread, stored
from tidemark.llm.hashing import mix, word_hashes

LEAST, SHARE, TOP, WORDS = 10, 50, 2000, 3
#: One place in so many begins a chunk; a chunk of LONGEST words without such a place is ended all the same.
TRIGGER, LONGEST = 24, 4096
#: Bits of the map of frequent phrases: at least, for each phrase, and at most (32 MB).
_BITS = 1 << 16, 16, 1 << 28
#: Bytes of text or chunks that a task holds at once.
_HELD = 8 << 20
#: Capitals become small letters, what ends a piece a line feed, tab a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Strength of what stands between words: nothing, space, end of a piece, end of a text.
_GAP = np.zeros(256, np.uint8)
_GAP[[32, 10, 13]] = 1, 2, 3


def _held(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The batches, put together or cut to tables of about _HELD bytes."""
    found, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found.append(part)
            size += part.column(column).nbytes
            if size >= _HELD:
                yield pa.Table.from_batches(found)
                found, size = [], 0
    if found:
        yield pa.Table.from_batches(found)


def _cut(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece does, which no phrase reaches beyond."""
    at = 0
    while len(raw) - at > _HELD and (end := _END.search(raw, at + _HELD // 2)):
        yield raw[at : end.end()]
        at = end.end()
    yield raw[at:]


def parse(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(number of the text, chunk) for each chunk. Words stand between single bytes: a space within a piece, a line feed
    after it. The two last words of a chunk are those of the next one, or empty at the end of a text."""
    raw = b"\r" + b"".join(t.translate(_FOLD) + b"\r" for t in texts)
    hashes, starts = word_hashes(raw)
    if not len(starts):
        return [], []
    buf = np.frombuffer(raw, np.uint8)
    gap = _GAP[buf]
    apart = gap > 0
    ends = np.flatnonzero(apart & ~np.concatenate([[True], apart[:-1]]))
    after = np.maximum.reduceat(gap, ends)
    last = after == 3
    text = np.searchsorted(np.flatnonzero(buf == 13), starts) - 1
    # single bytes between the words
    keep = ~apart
    keep[ends] = True
    place = np.cumsum(keep) - 1
    plain = buf.copy()
    plain[ends] = np.where(after == 1, 32, 10)
    plain = plain[keep].tobytes()
    starts, ends = place[starts], place[ends]

    pair = np.append(mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]), np.uint64(1))
    begins = (pair % np.uint64(TRIGGER) == 0) & ~last
    begins[np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])] = True
    at = np.flatnonzero(begins)
    wide = np.diff(np.append(at, len(begins)))
    for i in np.flatnonzero(wide > LONGEST):
        more = np.arange(at[i] + LONGEST, at[i] + wide[i], LONGEST)
        begins[more[~last[more]]] = True
    at = np.flatnonzero(begins)
    final = last[np.append(at[1:], len(begins)) - 1]
    to = np.append(at[1:], len(begins)) - 1
    stop = ends[np.where(final, to, np.minimum(to + 2, len(ends) - 1))]
    cuts = zip(starts[at].tolist(), stop.tolist(), final.tolist(), strict=True)
    return text[at].tolist(), [plain[a:b] + b"\n\n" if f else plain[a:b] for a, b, f in cuts]


def chunks(docs: DataFrame) -> DataFrame:
    """lang, chunk, freq: the dictionary of the parse with the number of times each chunk occurs."""

    def batch_of(langs: list[str], parts: list[bytes]) -> pa.RecordBatch:
        of, found = parse(parts)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(of, pa.int64())), pa.array(found, pa.binary())], ["lang", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, "text"):
            langs, parts, size = [], [], 0
            for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist(), strict=True):
                for part in _cut(text.encode()):
                    langs.append(lang)
                    parts.append(part)
                    size += len(part)
                    if size >= _HELD:
                        yield batch_of(langs, parts)
                        langs, parts, size = [], [], 0
            yield batch_of(langs, parts)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows).mapInArrow(run, "lang string, chunk binary").groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("freq"))


@dataclass(frozen=True)
class Frequent:
    """A bitmap of phrases by their hash."""

    bits: Broadcast

    def __call__(self, lang: str, phrases: list[bytes]) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        at = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))
        bits = self.bits.value
        at %= np.uint64(8 * len(bits))
        return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def frequent(counts: DataFrame) -> Frequent:
    """The bitmap of the phrases of counts (lang, phrase); its size follows their number up to a fixed bound."""
    spark = counts.sparkSession
    low, each, high = _BITS
    size = min(max(low, 1 << (each * counts.count()).bit_length()), high)
    at = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(size - 1))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = counts.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words["i"].to_numpy()] = words["bits"].to_numpy()
    return Frequent(spark.sparkContext.broadcast(bits.view(np.uint8)))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first of each different key, the sum of its weights, and the number of the key for each row."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    at = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[at], np.add.reduceat(weights[order], at), number


def phrases_of(lang: str, found: list[bytes], freq: np.ndarray, size: int, known: Frequent | None) -> tuple[list[bytes], np.ndarray]:
    """Phrases of `size` words that begin in the own words of the chunks, with their occurrences; of longer phrases only those
    of which all but the first and all but the last word are known."""
    raw = b"".join(c + b"\r" for c in found)
    buf = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(_GAP[buf] > 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    after = buf[ends]
    last = np.flatnonzero(after == 13)
    own = np.ones(len(ends), bool)
    own[last] = own[last - 1] = False
    weight = np.repeat(freq, np.diff(np.concatenate([[-1], last])))
    letters = np.delete(buf, ends)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many_words = int(number.max()) + 1
    within = after == 32

    def texts(at: np.ndarray, n: int) -> list[bytes]:
        return [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at + n - 1].tolist(), strict=True)]

    # places at which a phrase of n words stands in one piece, and a number for each different phrase
    at, key = np.arange(len(number)), number
    for n in range(2, size + 1):
        one, _, which = _summed(key, weight[at])
        same = np.zeros(len(number), np.int64)
        same[at] = which
        if n == size:
            yes = np.zeros(len(number), bool)
            yes[at] = known(lang, texts(at[one], n - 1))[which]
        at = at[within[at + n - 2]]
        if n == size:
            at = at[yes[at] & yes[at + 1]]
        key = same[at] * many_words + number[at + n - 1]
        if not len(at):
            break
    key, at = key[own[at]], at[own[at]]
    if not len(at):
        return [], np.empty(0, np.int64)
    one, total, _ = _summed(key, weight[at])
    return texts(at[one], size), total


def counted(parsed: DataFrame, size: int, known: Frequent | None = None) -> DataFrame:
    """lang, phrase, f: occurrences of the phrases of `size` words. Tasks add up what they hold before rows are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, "chunk"):
            langs = table.column("lang").combine_chunks().dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                part = table.take(pa.array(np.flatnonzero(which == i)))
                found, n = phrases_of(lang, part.column("chunk").to_pylist(), part.column("freq").to_numpy(), size, known)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])

    return parsed.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _firsts(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each lang, with their rank. Groups are ranked in parts first, then few parts, then whole, so
    that no task sorts all rows of a lang."""
    parts = many(rows.sparkSession)
    for n in (parts, max(1, int(parts**0.5))):
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).drop("rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The phrases of two or three words that stick together most, for each lang (null: und): lang, rank, phrase, a
    (occurrences), l and r (those of its parts at the weakest cut), n (words of the lang), score (millions of a*a / (l*r)).

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at spaces and tabs.
    A phrase of `least` or more occurrences is dropped if a longer one that holds it has `share` percent of them or more.
    The first `top` of each lang by score, a, phrase are returned; score ties are resolved by these, so ranks are unique.
    Rows are counted as often as they occur, whatever their doc_id, which is not looked at, like all other columns. A lang
    whose texts repeat nothing often enough, and an empty table, give no rows. Texts may be of any length.
    """
    parsed = stored(chunks(docs))
    words = stored(counted(parsed, 1))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = [words.where(F.col("f") >= least)]
    for size in range(2, WORDS + 1):
        often.append(stored(counted(parsed, size, frequent(often[-1])).where(F.col("f") >= least)))
    longer = often[-1].select("lang", F.split("phrase", " ").alias("w"), "f")
    inside = longer.select("lang", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    pairs = often[1].join(most, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("most") >= share * F.col("f"), F.lit(False))).drop("most")
    phrases = pairs.union(often[2]).withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    join = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    parts = stored(often[0].union(often[1]))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")), "below": big("l") * big("r")})
    weakest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = _firsts(scored, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
