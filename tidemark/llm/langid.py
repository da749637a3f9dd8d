"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier (log-ratios of hashed byte n-gram counts) says
on which side a text lies. Decoding takes the codeword of least loss, each bit weighted by how well its classifier
knows that language, and flags texts for which two codewords are about as near, measured on texts that were kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import exact, numbered, spread, stored

UNKNOWN = "und"
#: Buckets of hashed byte pairs and triples, labelled documents of each language to learn from at most, languages at most
#: (those with the most labelled documents): bounds on the model and on what is learned from.
BUCKETS, SAMPLE, LANGUAGES = 1 << 15, 1000, 200
#: A text is ambiguous if another codeword is nearer than this share of its usual distance for texts of the language.
NEAR = 0.5
#: A text is strange if its n-grams are less likely in the language than this share of what is usual there; to know what is
#: usual takes so many texts that were kept apart.
LIKELY, ENOUGH = 0.4, 5
_CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: Lower-case bytes: ASCII letters and all bytes of other characters stay, the rest becomes space.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def codewords(n: int, longest: int = 7, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1: all splits of the languages for few of them, else the random code of most distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= longest:
        columns = [(1, *bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(columns, np.int8).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = (rng.choice(np.array([-1, 1], np.int8), (n, width)) for _ in range(50))
    far = lambda code: (width - (code.astype(int) @ code.T.astype(int) + 2 * width * np.eye(n, dtype=int)).max()) // 2
    return max(tries, key=far)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte pairs and triples of the whole text, in chunks of bounded size."""
    raw = b" " + text.lower().encode().translate(_FOLD) + b" "
    for at in range(0, len(raw) - 2, _CHUNK):
        x = np.frombuffer(raw[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        pair = x[:-1] << np.uint32(8) | x[1:]
        triple = pair[:-1] << np.uint32(8) | x[2:]
        both = np.concatenate([pair[:-1] * np.uint32(2), triple * np.uint32(2) + np.uint32(1)])
        yield (both[x[np.tile(np.arange(1, len(x) - 1), 2)] != 32] * np.uint32(0x9E3779B1)) >> np.uint32(17)


def evidence(text: str, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum of the n-grams' log-ratios for each bit, and their number."""
    total, n = np.zeros(weights.shape[1]), 0
    for idx in grams(text):
        total += weights[idx].sum(0, dtype=np.float64)
        n += len(idx)
    return total, max(n, 1)


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    """One number a bit: above zero on the side of +1; grows with the root of the text's length."""
    total, n = evidence(text, weights)
    return np.clip(total / np.sqrt(n), -30, 30)


class Model:
    """What has been learned; its size depends on the number of languages only."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = counts + 0.5
        weights = []
        for column in self.code.T if langs else ():
            on, off = share[column > 0].sum(0), share[column < 0].sum(0) if (column < 0).any() else np.ones(share.shape[1])
            weights.append(np.log(on / on.sum()) - np.log(off / off.sum()))
        self.weights = np.array(weights, np.float32).T.copy() if langs else np.zeros((BUCKETS, 1), np.float32)
        each = share / share.sum(1, keepdims=True)
        self.own = np.log(each.T * BUCKETS).astype(np.float32)
        self.known = self.own.max(1, keepdims=True) if langs else np.zeros((BUCKETS, 1), np.float32)
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])
        self.scale, self.usual = np.ones(self.code.shape[1]), np.zeros(len(langs))
        self.likely = np.full(len(langs), -np.inf)

    def weigh(self, right: np.ndarray) -> None:
        """right: for each language and bit the share of sample texts on the right side."""
        known = np.clip(right - 0.5, 0.01, None)
        self.trust = known / known.sum(1, keepdims=True)

    def calibrate(self, langs: np.ndarray, each: np.ndarray, likely: np.ndarray) -> None:
        """Learns from texts of known language (langs: numbers, each: evidence() for a single n-gram, likely: likelihood()) how strong
        each bit usually is, how far off the nearest other codeword and how likely a text."""
        self.scale = np.maximum(np.median(np.abs(each), 0), 1e-9) if len(each) else self.scale
        for i in range(len(self.langs)):
            gaps = [self.apart(x, i) for x in each[langs == i]]
            self.usual[i] = np.median(gaps) if gaps else 0.0
            if len(gaps) >= ENOUGH:
                self.likely[i] = np.median(likely[langs == i])

    def apart(self, each: np.ndarray, lang: int) -> float:
        """How much farther off the nearest other codeword is, with each bit against its usual strength: the same for short and
        long texts of one language, about zero for a text that is half another one."""
        loss = (self.trust * np.clip(1 - self.code * (each / self.scale), 0, 2)).sum(1)
        others = np.delete(loss, lang)
        return float(others.min() - loss[lang]) if len(others) else np.inf

    def decode(self, text: str | None, near: float) -> tuple[str, float, bool]:
        """Language, share of the evidence from 0 to 1, and whether another codeword is nearer than `near` times as far as it usually
        is for texts of this language."""
        if not self.langs or not isinstance(text, str) or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        total, n = evidence(text, self.weights)
        f = np.clip(total / np.sqrt(n), -30, 30)
        loss = (self.trust * np.logaddexp(0, -self.code * f)).sum(1) * self.code.shape[1]
        best = int(loss.argmin())
        share = np.exp(loss[best] - loss)
        score = float(1 / share.sum())
        return self.langs[best], score, bool(self.apart(total / n, best) < near * self.usual[best])

    def likelihood(self, text: str, lang: int) -> float:
        """How much likelier an n-gram of the text is in a language than a bucket drawn at random, as a mean of logarithms."""
        total, n = evidence(text, self.own[:, lang : lang + 1])
        return float(total[0] / n)

    def strange(self, text: str, lang: str) -> bool:
        """Whether no learned language makes the text's n-grams likelier than buckets drawn at random, or the one that was decoded
        makes them far less likely than is usual there."""
        i = self.langs.index(lang)
        return margins(text, self.known)[0] < 0 or self.likelihood(text, i) < LIKELY * self.likely[i]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learns from at most `sample` labelled texts a language, those of the smallest hashes of doc_id, and of the `languages`
    with the most labelled texts. How far each classifier is trusted with a language is measured on every fifth text, by
    classifiers that were learned from the others.

    docs: doc_id, text, lang; rows without text or lang teach nothing.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.create_map(*[F.lit(v) for lang in langs for v in (lang, 2.0 * sample / sizes[lang] + 50.0 / sizes[lang])])
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    few = known.where(draw < bound[F.col("lang")]).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
    few = stored(few.select("text", "lang", (F.col("rank") % 5 == 0).alias("apart")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, bool], np.ndarray] = {}
        for pdf in batches:
            for text, lang, apart in zip(pdf["text"], pdf["lang"], pdf["apart"], strict=True):
                total = seen.setdefault((lang, apart), np.zeros(BUCKETS, np.int64))
                for idx in grams(text):
                    total += np.bincount(idx, minlength=BUCKETS)
        for (lang, apart), total in seen.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "apart": apart, "bucket": some.astype(np.int32), "n": total[some]})

    kind = "lang string, apart boolean, bucket int, n long"
    parts = few.mapInPandas(count, kind).groupBy("lang", "apart", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, len(langs), BUCKETS))
    counts[parts["apart"].to_numpy(int), parts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), parts["bucket"].to_numpy(int)] = parts["n"].to_numpy(float)
    model, other = Model(langs, counts.sum(0)), Model(langs, counts[0])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
            found = [evidence(t, other.weights) for t in pdf["text"]]
            likely = [other.likelihood(t, i) for t, i in zip(pdf["text"], at, strict=True)]
            yield pd.DataFrame({"lang": at, "each": [total / n for total, n in found], "likely": likely})

    # as many rows as a fifth of the sample, each of as many numbers as there are bits
    seen = few.where("apart").mapInPandas(judge, "lang int, each array<double>, likely double").toArrow()
    at, each = seen["lang"].to_numpy(), np.array(seen["each"].to_pylist(), float).reshape(seen.num_rows, model.code.shape[1])
    right = np.full(model.code.shape, 0.5)
    for i in np.unique(at):
        right[i] = (each[at == i] * model.code[i] > 0).mean(0)
    model.weigh(right)
    model.calibrate(at, each, seen["likely"].to_numpy())
    return model


def predict(docs: DataFrame, model: Model, near: float = NEAR) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row; only the text is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [model.decode(t, near) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said], "ambiguous": [x[2] for x in said]})

    rows = docs.select(exact("doc_id").alias("doc_id"), held_out().alias("held_out"), "text")
    return numbered(spread(rows).mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double, ambiguous boolean"))


def identify(docs: DataFrame) -> DataFrame:
    """The language of every row of docs (doc_id, text, lang), learned from the rows that are not held out.

    Null texts and texts without a letter are `und` with score 0. Ties between languages go to the first by name.
    Null ids are never held out; repeated rows are each returned; without labelled rows all are `und`. Other columns are
    not looked at; an empty table gives no rows.
    """
    return predict(docs, fit(docs.where(~held_out())))


def accepted(docs: DataFrame, least: float = 1.2) -> DataFrame:
    """The rows of docs whose language can be told: not `und`, not strange() to the learned languages, and not both
    ambiguous and of a score below `least` times the score of a guess.

    Null texts and those without a letter go; without labelled rows all do. Null and repeated ids are rows like others; all
    columns are kept; an empty table gives no rows."""
    model = fit(docs.where(~held_out()))
    least /= max(1, len(model.langs))

    def stays(text: str | None) -> bool:
        lang, score, ambiguous = model.decode(text, NEAR)
        return lang != UNKNOWN and not (ambiguous and score < least) and not model.strange(text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([stays(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
