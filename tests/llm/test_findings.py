"""Cases that a review found: unlearned languages, added tokens, frequent windows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_repeats import plain, words

WORDS = {
    "en": "the of and to in that was his with for they have this from",
    "de": "der die und nicht ein sich auch werden haben nach wird bei",
    "fr": "les une pour dans qui sur pas avec plus sont cette mais nous",
    "es": "los las una para con por como pero sus este entre cuando muy",
}
OTHER = ["αυτό είναι ένα κείμενο χωρίς γνωστή γλώσσα και πολλά γράμματα", "это текст на языке которого никто не учил", "zxqj kvvw qqzx xjkq wwzq vkxj jqqz kzzx"]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_unlearned_language_is_rejected(spark, n):
    from tidemark.llm.langid import accepted

    rng = np.random.default_rng(n)
    rows = [(lang, " ".join(rng.choice(WORDS[lang].split(), 40 * (k + 1)))) for k, lang in enumerate(list(WORDS)[:n]) for _ in range(40)]
    rows = [(i, text, lang) for i, (lang, text) in enumerate(rows)] + [(1000 + i, t, None) for i, t in enumerate(OTHER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in accepted(docs).collect()} == {i for i, _, lang in rows if lang}


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import op4_pack
    from tidemark.llm.stages import pack_stage

    texts = ["end <|endoftext|> x", "a<|startoftext|>b", "東京 <|endoftext|>", "<|ENDOFTEXT|> é", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in enumerate(texts)}
    for rows in (op4_pack(spark, str(tmp_path)), pack_stage(spark, docs, "")):
        assert {r["doc_id"]: r["ids_crc32"] for r in rows.collect()} == want


def test_frequent_passage_with_other_surroundings(spark, monkeypatch):
    """A passage that every text has, with other neighbours: a bucket meets its names once a piece, not once a text."""
    from tidemark.llm import repeats, substring_dedup, suffix_dedup

    passage = " ".join(f"p{i}" for i in range(45))
    texts = [f"{' '.join(f'a{k}x{i}' for i in range(9))} {passage} {' '.join(f'b{k}x{i}' for i in range(9))}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    sent, put = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df: sent.append(put(df)) or sent[-1])
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.digests(docs).collect()}
    assert found == {k: (len(x), int(gone.sum())) for k, (x, gone) in enumerate(plain(texts, words, 35, False))}
    assert sum(r["n"] for r in sent[0].collect()) == 200 * (63 - 34) - 199 * 11
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(docs).collect()}
    assert Counter(found.values()) == Counter(int(gone.sum()) for _, gone in plain(texts, lambda t: list(t.encode()), 100, True))
