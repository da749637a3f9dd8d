"""Byte-level BPE against the public library, and the round trip."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

ODD = [None, "", " ", "\n", "a  b \n c\n \nd ", "  x", "x  ", "\x1c a\x85b", "aaaa" * 200 + " 東京　é", "it's 123 ok!!", "###" * 50, "\x00\x01 \x7f", "a\0b c", " lead"]
draw = random.Random(3)
LONG = [
    "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)),
    "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(5_000)),
    "".join(draw.choice("!?.,;:#-=*") for _ in range(16_000)),
    "aab" * 700 + " " + "é" * 300,
    "some words and Others, " * 150_000,
    "x" * 70 + " " + "die Straße " * 10,
]
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def expected(docs):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), digest(",".join(map(str, ids)).encode()), digest((r["text"] or "").encode())] += 1
    return want


@pytest.mark.parametrize("which", ["odd", "long", "documents"])
def test_byte_bpe(spark, sf, which):
    from tidemark.llm.byte_bpe import encode_decode

    if which == "documents":
        docs = spark.read.parquet(f"{sf}/documents.parquet")
    else:
        docs = spark.createDataFrame([(i % 7 or None, t, 1) for i, t in enumerate(ODD if which == "odd" else LONG)], "doc_id long, text string, n_tokens long")
    rows = encode_decode(docs, PATH, public_tokenizers.PATTERN)
    assert Counter(tuple(r) for r in rows.collect()) == expected(docs)
    assert encode_decode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_one_place_a_round_gives_the_same(monkeypatch):
    """The way for vocabularies whose merges can lead to smaller ranks, and states that are stored after a few rounds."""
    from tidemark.llm import byte_bpe

    words = ["thheingbleaaaabb" * 9, "ab" * 60, "x" * 90, LONG[1][:60]]
    coder = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    coder.meet(words)
    other = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    other._one_way = False
    monkeypatch.setattr(byte_bpe, "_STEPS", 2000)
    other.meet(words)
    assert coder.ids == other.ids and all(coder.raw[w] == w.encode() for w in words)


def test_memory_is_bounded_by_bytes(monkeypatch):
    """Texts without spaces are one stretch each: none is kept, and what is kept stays below the bound."""
    from tidemark.llm import byte_bpe

    coder = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "_HELD", 100_000)
    for k in range(20):
        texts = [f"no.spaces,at-all;{k}:" * 60, f"word{k} and more"]
        stretches = [s for t in texts for s in coder.stretches(t)]
        coder.meet(stretches)
        assert b"".join(coder.raw[s] for s in stretches) == "".join(texts).encode()
        coder.forget(stretches)
        assert all(len(s) <= 200 for s in coder.ids)
        assert coder._held == sum(260 + 2 * len(coder.raw[s]) + len(coder.ids[s]) for s in coder.ids) < 150_000
