"""Collocations against a count of all phrases in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as c


def brute(docs, least=10, share=50, top=2000):
    counts, total, out = {}, Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and f[q] >= least and 100 * f[q] >= share * a and p in (q[:2], q[1:]) for q in f):
                continue
            score, k, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def made(spark, docs, **kw):
    frame = spark.createDataFrame([(i, t, lang, "phrase") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string")
    rows = c.collocations(frame, **kw).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "New", "york", "city", "é", "straße", "a", "b c", "x y", "of", "日本", "#tag"]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "\r\n", "\x0b", "! ", ":"]
    docs = []
    for _ in range(n):
        text = "".join(w + rng.choice(gaps) for w in rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60)))
        docs.append((rng.choice(["en", "fr", None]), rng.choice(["", " ", "\n"]) + text))
    return docs + [("en", None), ("en", ""), ("en", " .\n "), (None, "New york city. " * 40), ("de", "ja " * 3000)] + docs[:20]


@pytest.mark.parametrize("trigger,longest,held", [(1, 40, 1 << 20), (2, 40, 200), (24, 7, 1 << 20), (24, 4096, 100), (10**9, 3, 50)])
def test_counts_are_the_same_wherever_chunks_begin(monkeypatch, trigger, longest, held):
    for name, value in (("TRIGGER", trigger), ("LONGEST", longest), ("_HELD", held)):
        monkeypatch.setattr(c, name, value)
    texts = [(text or "").encode() for _, text in corpus(trigger % 97, 80)]
    chunks = Counter(f for text in texts for f in c.parse(list(c._cut(text)))[1])
    chunks_at_once = Counter(c.parse([part for text in texts for part in c._cut(text)])[1])
    assert chunks == chunks_at_once
    found, freq = list(chunks), np.array(list(chunks.values()))
    want = {k: Counter() for k in (1, 2, 3)}
    for text in texts:
        lower = bytes(x + 32 if 65 <= x <= 90 else x for x in text)
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for k in want:
                want[k].update(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    for k in want:
        phrases, n = c.phrases_of("en", found, freq, k, lambda lang, ps: np.ones(len(ps), bool))
        assert len(set(phrases)) == len(phrases) and dict(zip(phrases, n.tolist(), strict=True)) == want[k]
        often = {p for p, x in want[k - 1].items() if x >= 5} if k > 1 else None
        phrases, n = c.phrases_of("en", found, freq, k, lambda lang, ps: np.array([p in often for p in ps], bool))
        kept = {p: x for p, x in want[k].items() if k == 1 or b" ".join(p.split(b" ")[:-1]) in often and b" ".join(p.split(b" ")[1:]) in often}
        assert dict(zip(phrases, n.tolist(), strict=True)) == kept


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    docs = corpus(seed)
    got = made(spark, docs)
    assert got == brute(docs) and len({r[0] for r in got}) == 4


def test_ranks_of_ties_and_the_limit(spark):
    text = ". ".join(f"{a} {b}" for a in ("k", "m", "é", "z") for b in ("p", "q")) + ". "
    docs = [("en", text * 12), ("en", text.upper())]
    assert made(spark, docs, top=5) == brute(docs, top=5)


def test_chunks_tile_the_text():
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefghij") for _ in range(3000))
    of, found = c.parse([text.encode(), b"", b"one", b" . ", b"two words"])
    own = [w for i, f in zip(of, found, strict=True) if i == 0 for w in f.replace(b"\n", b" ").split(b" ")[:-2]]
    assert b" ".join(own).decode() == text and len(found) > 50
    assert [f for i, f in zip(of, found, strict=True) if i > 0] == [b"one\n\n", b"two words\n\n"]
    twice = c.parse([("first words here " + text).encode(), ("others " + text).encode()])[1]
    assert len(set(twice)) < len(twice) * 0.6


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """Of 64 bits, so that most phrases are taken for frequent ones."""
    monkeypatch.setattr(c, "_BITS", (64, 1, 64))
    docs = corpus(9, 60)
    assert made(spark, docs) == brute(docs)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(c, "_HELD", 200)
    text = b"one two. " * 100
    assert len(list(c._cut(text))) > 5 and b"".join(c._cut(text)) == text and list(c._cut(b"a b" * 500)) == [b"a b" * 500]


def test_no_rows(spark):
    assert made(spark, []) == []


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 3_000_000_000_001
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 7).alias("l"), F.lit(big + 9).alias("r"))
    cast = lambda x: F.col(x).cast("decimal(16,0)")
    row = row.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * (cast("a") * cast("a")), "below": cast("l") * cast("r")})
    assert row.select(F.expr("above div below")).first()[0] == 1_000_000 * big * big // ((big + 7) * (big + 9))
