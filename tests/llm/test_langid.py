"""Language identification against a plain decoder, on both sides of the switch of codes, and its bounds."""

import math
from collections import Counter

import numpy as np
import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def languages(n, seed=1, texts=30):
    """Made languages: each has words of its own preferred letters."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        odds = rng.dirichlet(np.full(26, 0.5))
        words = ["".join(rng.choice(list(LETTERS), rng.integers(2, 8), p=odds)) for _ in range(80)]
        out += [(f"l{k:02d}", " ".join(rng.choice(words, rng.integers(20, 60)))) for _ in range(texts)]
    return [(i, text, lang) for i, (lang, text) in enumerate(out)]


def plain_grams(text):
    raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in (" " + text.lower() + " ").encode())
    for i in range(len(raw) - 2):
        if raw[i + 1] != 32:
            a, b, c = raw[i : i + 3]
            yield ((a << 8 | b) * 2 * 0x9E3779B1) % 2**32 >> 17
            yield (((a << 16 | b << 8 | c) * 2 + 1) * 0x9E3779B1) % 2**32 >> 17


def plain_decode(model, counts, text):
    """Nearest codeword by loss, from counts of n-grams alone."""
    share = {lang: {b: n + 0.5 for b, n in c.items()} for lang, c in counts.items()}
    losses = []
    margins = []
    found = list(plain_grams(text))
    for bit in range(model.code.shape[1]):
        sides = {1: [], -1: []}
        for lang, sign in zip(model.langs, model.code[:, bit], strict=True):
            sides[int(sign)].append(lang)
        rate = lambda langs, b: sum(share[x].get(b, 0.5) for x in langs)
        whole = lambda langs: sum(sum(counts[x].values()) + 0.5 * 2**15 for x in langs)
        total = sum(math.log(rate(sides[1], b) / whole(sides[1])) - math.log(rate(sides[-1], b) / whole(sides[-1])) for b in found)
        margins.append(max(-30, min(30, total / math.sqrt(max(len(found), 1)))))
    for row, trust in zip(model.code, model.trust, strict=True):
        losses.append(len(row) * sum(w * math.log1p(math.exp(-s * f)) if -s * f < 30 else w * -s * f for w, s, f in zip(trust, row, margins, strict=True)))
    best = min(range(len(losses)), key=losses.__getitem__)
    return model.langs[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


@pytest.mark.parametrize("n", [3, 9])
def test_decoding_is_that_of_a_plain_decoder(spark, n):
    from tidemark.llm.langid import fit, predict

    rows = languages(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    counts = {}
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_grams(text))
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, model).collect()}
    for i, text, _ in rows[:: len(rows) // 40]:
        lang, score = plain_decode(model, counts, text)
        assert said[i][0] == lang and said[i][1] == pytest.approx(score, rel=1e-3)
    assert np.allclose(model.trust.sum(1), 1)


@pytest.mark.parametrize("n", [2, 7, 8, 20])
def test_texts_that_taught_nothing_are_known(spark, n):
    """On both sides of seven languages, where exhaustive codes give way to random ones."""
    from tidemark.llm.langid import fit, predict

    rows = languages(n, texts=40)
    taught = spark.createDataFrame([r for r in rows if r[0] % 4], "doc_id long, text string, lang string")
    rest = {i: lang for i, _, lang in rows if i % 4 == 0}
    said = {r["doc_id"]: r["lang_pred"] for r in predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit(taught)).collect()}
    assert sum(said[i] == lang for i, lang in rest.items()) >= 0.97 * len(rest)


def test_languages_are_bounded(spark):
    """Labels beyond the bound, the rarest, teach nothing."""
    from tidemark.llm.langid import fit

    rows = languages(3) + [(1000 + i, "noise", f"x{i}") for i in range(50)]
    assert fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3).langs == ["l00", "l01", "l02"]


def mixed(rows, seed=4):
    """Texts that are half one made language and half another."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(100):
        a, b = rng.choice(len(rows), 2, replace=False)
        while rows[a][2] == rows[b][2]:
            b = rng.integers(len(rows))
        x, y = rows[a][1].split(), rows[b][1].split()
        n = min(len(x), len(y))
        out.append((10_000 + i, " ".join(x[:n] + y[:n]), None))
    return out


@pytest.mark.parametrize("n", [2, 4, 9])
def test_texts_between_two_languages_are_flagged(spark, n):
    from tidemark.llm.langid import fit, predict

    rows = languages(n, texts=60)
    kind = "doc_id long, text string, lang string"
    model = fit(spark.createDataFrame([r for r in rows if r[0] % 4], kind))
    said = {r["doc_id"]: r["ambiguous"] for r in predict(spark.createDataFrame(rows + mixed(rows), kind), model).collect()}
    assert sum(said[10_000 + i] for i in range(100)) >= 90
    pure = [said[i] for i, _, _ in rows if i % 4 == 0]
    assert sum(pure) <= 0.05 * len(pure)


def test_halves_of_the_given_documents(spark):
    from tidemark.llm.langid import fit, held_out, predict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    rest = [(r["doc_id"], r["text"], r["lang"]) for r in docs.where(held_out()).collect() if len(r["text"].split()) >= 20]
    halves = mixed(rest)
    said = {r["doc_id"]: r["ambiguous"] for r in predict(spark.createDataFrame(rest + halves, "doc_id long, text string, lang string"), model).collect()}
    flagged, pure = sum(said[i] for i, _, _ in halves), sum(said[i] for i, _, _ in rest) / len(rest)
    assert flagged >= 90 and pure <= 0.05, (flagged, pure)


FOREIGN = [
    "ciao come stai oggi, spero che tutto vada bene e che la famiglia sia in buona salute", "de hond loopt door het park en de kinderen spelen met een bal in de zon",
    "gallia est omnis divisa in partes tres quarum unam incolunt belgae", "asdf qwer zxcv asdf jkl", "asdf qwer zxcv", '<div class="x"><a href="foo">bar</a></div>', "def f(x): return x+1", "ok",
    "это текст на языке которого никто не учил", "zxqv bnmk wrtp qqqq xxzz",
]


def test_what_no_language_explains_is_rejected_and_the_given_documents_stay(spark):
    from tidemark.llm.langid import accepted

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in accepted(docs.unionByName(foreign)).select("doc_id").collect()}
    assert not [t for i, t in enumerate(FOREIGN) if 10**9 + i in kept]
    assert len(kept) >= 0.99 * docs.count()
