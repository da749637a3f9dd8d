"""Substring and byte dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, one long, piece string, docs string, bucket long"
MORE = ("l", "s", 1, "p", "d", 1)


def plain(texts, unit, window, first_stays):
    """texts in order; for each the items and which of them go."""
    items = [unit(t or "") for t in texts]
    seen = Counter()
    for x in items:
        for p in range(len(x) - window + 1):
            seen[tuple(x[p : p + window])] += 1
    met, out = set(), []
    for x in items:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - window + 1):
            w = tuple(x[p : p + window])
            if (w in met) if first_stays else seen[w] > 1:
                gone[p : p + window] = True
            met.add(w)
        out.append((x, gone))
    return out


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def kept(text, gone):
    """The text itself, or its kept runs of words as they stand in it, with one space between runs."""
    if not gone.any():
        return text
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    runs = re.finditer("k+", "".join("g" if g else "k" for g in gone))
    return " ".join(text[spans[m.start()][0] : spans[m.end() - 1][1]] for m in runs)


def made(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "bb", "é", "the", "x" * 9, "of", "and"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base = [say(150) for _ in range(4)]
    texts = [None, "", " \n", "word", "a " * 400, "x" * 500, "x" * 99, "x" * 100, base[0], base[0], base[0] + " extra " + base[1], "\n lines\tand\n\n" + say(9)]
    for _ in range(25):
        part = base[rng.integers(4)].split()
        at = rng.integers(0, 100)
        near = [*base[rng.integers(4)].split()]
        for i in rng.integers(0, len(near), 3):
            near[i] = "edit"
        texts += [say(30) + "\n " + " ".join(part[at : at + 50]) + " " + say(20), " ".join(near), say(60)]
    return texts


@pytest.fixture(params=["one piece", "pieces of a few texts"])
def size(request, monkeypatch):
    from tidemark.llm import repeats

    if request.param != "one piece":
        monkeypatch.setattr(repeats, "BUCKET", 64)
        whole = repeats.pieces
        for name in ("substring_dedup", "suffix_dedup"):
            monkeypatch.setattr(f"tidemark.llm.{name}.pieces", lambda docs, columns: whole(docs, columns, 1500))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed, size):
    from tidemark.llm.substring_dedup import digests, kept_texts

    texts = made(seed)
    docs = spark.createDataFrame([(3 * i, t, *MORE) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:] for r in digests(docs).collect()}
    kept_text = {r["doc_id"]: r["text"] for r in kept_texts(docs).collect()}
    assert len(got) == len(kept_text) == len(texts)
    for i, (x, gone) in enumerate(plain(texts, words, 35, False)):
        rest = b" ".join(w for w, g in zip(x, gone) if not g)
        assert got[3 * i] == (len(x), int(gone.sum()), hashlib.sha256(rest).hexdigest()), i
        assert kept_text[3 * i] == kept(texts[i] or "", gone)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length", [100, 37])
def test_byte_dedup(spark, seed, length, size):
    from tidemark.llm.suffix_dedup import digests

    texts = made(seed)
    docs = spark.createDataFrame([(3 * i, t, *MORE) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in digests(docs, length).collect()}
    for i, (x, gone) in enumerate(plain(texts, lambda t: list(t.encode()), length, True)):
        rest = bytes(b for b, g in zip(x, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[3 * i] == (len(x), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()), i


def test_repeated_and_missing_ids(spark):
    from tidemark.llm.substring_dedup import digests
    from tidemark.llm.suffix_dedup import digests as byte_digests

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, *MORE), (1, text, *MORE), (None, "short", *MORE), (2, *[None] * 7)], SCHEMA)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in digests(docs).collect()) == Counter({(1, 40, 40): 2, (None, 1, 0): 1, (2, 0, 0): 1})
    assert Counter(r["n_removed"] for r in byte_digests(docs).collect()) == Counter({0: 3, len(text): 1})
    late = spark.createDataFrame([(9, text), (None, text), (4, text), (9, "x")], "doc_id long, text string").repartition(3)
    assert Counter((r["doc_id"], r["n_removed"]) for r in byte_digests(late).collect()) == Counter([(4, 0), (9, len(text)), (None, len(text)), (9, 0)])
    assert digests(docs.limit(0)).count() == byte_digests(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    """A text of several megabytes that repeats itself and another one, among short ones."""
    from tidemark.llm.substring_dedup import digests
    from tidemark.llm.suffix_dedup import digests as byte_digests

    rng = np.random.default_rng(4)
    long = " ".join(map(str, rng.integers(0, 10**7, 700_000)))
    part = long[2_000_000:2_001_000].split(" ", 1)[1].rsplit(" ", 1)[0]
    docs = spark.createDataFrame([(1, long + " " + part), (2, "start " + part + " end"), (3, "other words")], "doc_id long, text string")
    n = len(part.split())
    assert {r["doc_id"]: r["n_removed"] for r in digests(docs).collect()} == {1: 2 * n, 2: n, 3: 0}
    gone = {r["doc_id"]: r["n_removed"] for r in byte_digests(docs).collect()}
    assert gone[1] - len(part) in (1, 0) and gone[2] - len(part) in (2, 1, 0) and gone[3] == 0


def test_names_that_share_leading_bits():
    """Names are told apart by all their bits."""
    from tidemark.llm.repeats import Names, heard, ordered

    one = np.array([5, 5, 7, 5, 7], np.uint64) << np.uint64(60)
    two = np.array([1, 2, 3, 1, 3], np.uint64)
    names = Names(one, two).sort(3)
    assert names.of[0] == names.of[3] != names.of[1] and names.of[2] == names.of[4]
    assert names.firsts().tolist() == [True, True, True, False, False]
    assert [n for _, n, *_ in names.slices(3)] == [2, 1]
    order, first = ordered(one, names.rest, names.last)
    assert len(first) == 3 and sorted(order.tolist()) == [0, 1, 2, 3, 4]
    answers = [{"bucket": 3, "n": 1, "again": b"\x80"}, {"bucket": 2, "n": 2, "again": b"\x40"}]
    assert heard(names, answers, "again").sum() in (3, 4)


def test_rolling_is_the_hash_of_each_window():
    from tidemark.llm.hashing import doubled_at, rolling

    rng = np.random.default_rng(5)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    items[200:240] = items[20:60]
    one, two = rolling(items, 35)
    assert len(one) == 266 and (one[200:206] == one[20:26]).all() and (two[200:206] == two[20:26]).all()
    assert len(set(one.tolist())) == len(set(two.tolist())) == 260
    raw = rng.integers(0, 256, 1000, dtype=np.uint8).tobytes()
    raw = raw[:600] + raw[100:250] + raw[750:]
    ranks = doubled_at(raw, np.arange(901), 100)[0]
    assert (ranks[600:651] == ranks[100:151]).all() and len(set(ranks.tolist())) == 850


def test_long_words_and_segments():
    from tidemark.llm import hashing

    raw = b"ab " * 500_000 + b"y" * 2_000_000 + b" ab"
    h, places = hashing.word_hashes(raw)
    assert len(h) == 500_002 and h[0] == h[-1] == h[499_999] and h[-2] != h[0]
    assert places[0] == 0 and places[1] == 3 and places[-1] == len(raw) - 2
