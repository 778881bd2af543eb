import random
import time

import numpy as np
import odd_rows
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dayloom.llm import sentencepiece_viterbi as V, token_counts as C

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    signs = [chr(i) for i in range(1, 0x250)] + list("ΣσİÀ\x85\xa0   　​😀́中가ﬁ½٠²")
    plain = ["the", "ing", "aaaa", "'s", "'LL", " ", "  ", "\n", "-", "==", "0000", "a", "b", "▁"]
    texts = ["".join(rng.choice(signs if rng.random() < 0.3 else plain) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return texts + ["a" * 1000, " " * 77, "ab" * 700, "", "a\x1cb \x1f", "<|endoftext|>x<|startoftext|> <|endoftext", "<|"]


@pytest.fixture(scope="module")
def pieces():
    return V.PieceModel(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_counts_are_the_librarys():
    library, texts = Tokenizer.from_file(WORD), odd_texts(3000)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert C.TokenCounter(WORD).counts(texts) == want


def test_counts_do_not_depend_on_what_is_known(monkeypatch):
    texts = odd_texts(300)
    want = C.TokenCounter(WORD).counts(texts)
    monkeypatch.setattr(C, "KNOWN_BYTES", 1000)
    monkeypatch.setattr(C, "PART_BYTES", 50)
    assert C.TokenCounter(WORD).counts(texts) == want


@pytest.mark.parametrize("long", [0, 3, 40])
def test_long_words_are_the_librarys(monkeypatch, long):
    """Words whose pairs are filed by rank: random, repeated, and the odd texts."""
    monkeypatch.setattr(C, "LONG", long)
    rng, library = random.Random(4), Tokenizer.from_file(WORD)
    texts = odd_texts(400, 7) + ["".join(rng.choice("abcdeéz") for _ in range(n)) for n in (1, 2, 300, 3000, 9000)]
    texts += ["a" * 5001, "abab" * 800, "the" * 3000, "aab" * 1000 + "ba"]
    assert C.TokenCounter(WORD).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_time_of_a_long_word():
    rng, library = random.Random(5), Tokenizer.from_file(WORD)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.perf_counter()
    count = C.TokenCounter(WORD).counts([text])
    assert time.perf_counter() - began < 10 and count == [len(library.encode(text, add_special_tokens=False).ids)]


def test_what_is_known_is_bounded_by_bytes(monkeypatch, pieces):
    monkeypatch.setattr(C, "KNOWN_BYTES", 20_000)
    monkeypatch.setattr(C, "PART_BYTES", 1000)
    monkeypatch.setattr(V, "KNOWN_BYTES", 20_000)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.choice([5, 20, 500]))) for _ in range(20)) for _ in range(200)]
    counter, model = C.TokenCounter(WORD), V.PieceModel(PIECE)
    for text in texts:
        counter.counts([text])
        model.encode_batch([text])
        for known, module in ((counter.known, C), (model.known, V)):
            assert all(len(run) <= module.KEPT for run in known)
            assert sum(len(run) + module.PER_RUN for run in known) <= 20_000 + 20 * (module.KEPT + module.PER_RUN)


def test_ids_are_the_librarys(pieces):
    model, library = pieces
    for text in odd_texts(3000):
        assert np.frombuffer(model.encode(text), "<i4").tolist() == library.encode(text)


def test_streaming_without_cuts(pieces):
    model, library = pieces
    for text in ["".join(odd_texts(60, seed)).replace("▁", "") for seed in range(5)]:
        assert model.encode_symbols("▁" + text.replace(" ", "▁")) == library.encode(text)


def test_decoding_is_the_librarys(pieces):
    model, library = pieces
    texts = odd_texts(500)
    ids = [library.encode(t) for t in texts] + [[5, 300, 200, 2, 0, 259], [3 + 0xE2, 3 + 0x82]]
    got = model.decode_batch([np.array(i, "<i4").tobytes() for i in ids])
    assert got[: len(texts)] == [library.decode(i) for i in ids[: len(texts)]]
    assert [a for a, b in zip(texts, got) if a != b and "▁" not in a] == []


def test_unigram_paths(pieces, monkeypatch):
    """With scores instead of merges, the path has the highest sum of all segmentations."""
    model = object.__new__(V.PieceModel)
    model.pieces = ["a", "b", "ab", "aba", "bab", "c"]
    model.ids = {p: i for i, p in enumerate(model.pieces)}
    model.score = dict(zip(model.pieces, [-2.0, -2.5, -3.0, -5.2, -4.0, -1.0]))
    model.length, model.longest, model.is_bpe = [len(p) for p in model.pieces], 3, False
    model.byte_ids, model.unknown, model.unknown_score = {}, 9, -20.0
    model.ends = model._trie_of_ends()

    def best(text):
        if not text:
            return 0.0
        return max(model.score.get(text[:n], -20.0 if n == 1 else -1e9) + best(text[n:]) for n in range(1, min(3, len(text)) + 1))

    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 11)))
        ids = model.encode_symbols(text)
        assert sum(-20.0 if i == 9 else model.score[model.pieces[i]] for i in ids) == pytest.approx(best(text))
    long = "".join(rng.choice("abc") for _ in range(3000))
    whole = model.encode_symbols(long)
    assert "".join(model.pieces[i] for i in whole) == long


def test_odd_rows(spark):
    docs = odd_rows.odd(spark, "The cat", "▁")
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(docs, WORD).collect()}
    assert (None, 0, 0, False) in counts and (10, 7, 2, False) in counts and (1, 3, 0, False) in counts
    assert any(i == 3 and over for i, _, _, over in counts)
    rows = V.encode_decode(docs, PIECE).collect()
    assert len(rows) == 9 and [r.lossless for r in rows if r.doc_id == 11] == [False]
    assert all(r.lossless and len(r.ids) == r.n_tokens for r in rows if r.doc_id != 11)
    assert C.token_counts(odd_rows.empty(spark), WORD).count() == 0
    assert V.encode_decode(odd_rows.empty(spark), PIECE).count() == 0
