"""SimHash near-dedup, language ID, packing and token counts against brute force, with odd rows."""

import functools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

ODD = [
    (1, "Alpha beta gamma", "en", "s", 16, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "s", 0, "x"),
    (4, " \t\n ", "en", "s", 4, "x"),
    (5, "one", "en", "s", 3, "x"),
    (5, "one", "en", "s", 3, "x"),
    (None, "Alpha beta gamma", "en", "s", 16, "x"),
    (7, "naïve Æther 東京 42 don't stop!! <|endoftext|>", "en", "s", 9, "x"),
    (8, "long text of many words " * 3000, "en", "s", 9, "x"),
    (9, "#" * 3000 + " 12345²", "de", "s", 9, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2 and top(a) != top(b):
                group[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            low[top(a)] = min(i, low.get(top(a), i))
    return Counter((i, f"{f:016x}", low.get(top(a))) for a, (i, f) in enumerate(prints))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates(which, request):
    from tidemark.llm.simhash_dedup import near_duplicates

    docs = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in near_duplicates(docs).collect())
    assert got == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_links_at_distance_two(spark):
    from tidemark.llm.simhash_dedup import links

    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(-(2**62), 2**62, 40)}
    for x in list(prints):
        for _ in range(3):
            prints.add(x ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))))
    rows = links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    joined = {x: x for x in prints}

    def top(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for u, v in rows:
        assert (u ^ v).bit_count() <= 2
        joined[top(u)] = top(v)
    for a in prints:
        for b in prints:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                assert top(a) == top(b)


def test_long_chain_component(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(100)] + [(500, 500), (300, 301), (301, 300)]
    rows = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert rows == {**{i: 0 for i in range(101)}, 300: 300, 301: 300}


def test_empty_tables(spark, odd):
    from tidemark.llm.langid import identify
    from tidemark.llm.packing import pack
    from tidemark.llm.simhash_dedup import near_duplicates
    from tidemark.llm.token_counts import token_counts

    none = odd.limit(0)
    assert near_duplicates(none).count() == identify(none).count() == pack(none).count() == 0
    assert token_counts(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_language_held_out(spark, documents, odd):
    from tidemark.llm.langid import identify

    rows = identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    said = {r["doc_id"]: r["lang_pred"] for r in identify(odd).collect()}
    assert said[2] == said[3] == said[4] == "und" and said[1] in ("en", "de")
    assert {r["lang_pred"] for r in identify(odd.where("lang is null").union(odd.limit(1).withColumn("lang", F.lit(None)))).collect()} == {"und"}


def test_language_ignores_labels(documents):
    from tidemark.llm.langid import fit, held_out, predict

    model = fit(documents.where(~held_out()))
    said = predict(documents, model).select("doc_id", "lang_pred")
    other = predict(documents.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred")
    assert said.exceptAll(other).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20])
def test_codewords_differ(n):
    from tidemark.llm.langid import codewords

    code = codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import pack

    docs = request.getfixturevalue(which)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    want = Counter()
    for r in docs.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], np.array(ids, "<u4").tobytes()] += 1
    rows = pack(docs, group=64).collect()
    ends, total = Counter(), 0
    for r in rows:
        assert 0 < r["length"] <= 2048 and r["start"] + r["length"] <= r["doc_tokens"]
        total += r["length"]
        ends[r["doc_id"]] += r["start"] + r["length"] == r["doc_tokens"]
    assert total == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    checks = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    for (doc, raw), n in want.items():
        for at in range(0, len(raw) // 4, 2048):
            part = raw[4 * at : 4 * (at + 2048)]
            assert checks[doc, at, len(part) // 4, zlib.crc32(part)] >= n
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048


def test_first_fit_decreasing_is_first_fit():
    from tidemark.llm.packing import first_fit_decreasing

    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 100, 300).tolist()
    got, room, want = first_fit_decreasing(sizes, 100), [], {}
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        bin_ = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if bin_ == len(room):
            room.append(100)
        want[i] = (bin_, 100 - room[bin_])
        room[bin_] -= sizes[i]
    assert got == [want[i] for i in range(300)]


@functools.cache
def longest_of(initial, continuing):
    return max(map(len, initial | continuing), default=0)


def greedy(word, initial, continuing):
    at, n, longest = 0, 0, longest_of(frozenset(initial), frozenset(continuing))
    while at < len(word):
        pool = initial if at == 0 else continuing
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


@functools.cache
def pieces_of(path):
    import base64

    with open(path, "rb") as f:
        return frozenset(base64.b64decode(x.split()[0]) for x in f)


def test_longest_match_counts():
    from tidemark.llm.token_counts import LongestMatch

    rng = np.random.default_rng(9)
    for _ in range(30):
        draw = lambda k: {bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(k)}
        initial, continuing = draw(8), draw(8)
        count = LongestMatch(initial, continuing)
        for _ in range(200):
            word = bytes(rng.choice(list(b"abc"), rng.integers(1, 12)).tolist())
            assert count[word] == greedy(word, initial, continuing), (word, initial, continuing)


def test_token_counts(documents, odd):
    from tidemark.llm.token_counts import token_counts

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces = pieces_of(path)
    count = functools.cache(lambda word: greedy(b" " + word, pieces, pieces))
    for docs in (documents.limit(30), odd):
        want = Counter()
        for r in docs.collect():
            words = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())
            want[r["doc_id"], len(words), sum(map(count, words))] += 1
        assert Counter(tuple(r) for r in token_counts(docs, path).collect()) == want


def test_large_ids_beside_null_ones(spark):
    from tidemark.llm.byte_bpe import encode_decode
    from tidemark.llm.langid import accepted, identify
    from tidemark.llm.packing import pack
    from tidemark.llm.simhash_dedup import near_duplicates
    from tidemark.llm.substring_dedup import digests
    from tidemark.llm.suffix_dedup import digests as byte_digests
    from tidemark.llm.token_counts import token_counts

    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "some words of text", "en", "s", None), (None, "other words", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for frame in (encode_decode(docs, path, public_tokenizers.PATTERN), identify(docs), accepted(docs), pack(docs), near_duplicates(docs), digests(docs), byte_digests(docs), token_counts(docs, path)):
        assert {r["doc_id"] for r in frame.collect()} == {big, None}, frame.columns
