"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint is sent to all numbers within half the radius of it. Two fingerprints are within the radius
exactly if they meet at some number, and all that meet at one number are within the radius of each other, so a chain
through each meeting place keeps every connection without listing all pairs. A meeting place holds at most as many
fingerprints as a ball has points (65 for radius 2), whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import exact, many, numbered, spread, stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once, a bound on memory for very long texts.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles; zero without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        raw = np.array(hashes[at : at + _BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed long) of every row. Null texts count as empty; null ids and repeated rows stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [fingerprint(t if isinstance(t, str) else None, shingle) for t in pdf["text"]]})

    rows = docs.select(exact(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return numbered(spread(rows).mapInPandas(run, "doc_id string, fp long"))


def masks(radius: int) -> list[int]:
    """Signed numbers with at most radius bits set."""
    out = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """u, v: verified pairs of different fingerprints within the radius that connect all that are connected.

    prints: column fp, distinct. The radius is even, so that a meeting at half of it proves a link.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    spark = prints.sparkSession
    variants = prints.select("fp", F.explode(F.array(*map(F.lit, masks(radius // 2)))).alias("mask"))
    variants = variants.select("fp", F.expr("fp ^ mask").alias("at")).repartition(many(spark), "at")
    before = F.lag("fp").over(Window.partitionBy("at").orderBy("fp"))
    met = variants.select(F.col("fp").alias("v"), before.alias("u")).where("u is not null")
    return met.distinct().where(F.expr(f"bit_count(u ^ v) <= {radius}"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    component_id is the smallest doc_id among documents that can be reached by links of at most `radius` differing
    bits, the document itself included; null only if the whole component has null ids. Equal fingerprints are one
    class, which is linked once. Null and empty texts have fingerprint zero and are linked like others. Rows that repeat
    an id are all returned. Other columns of docs are not looked at; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
