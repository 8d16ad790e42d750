"""Byte-level BPE and token counts against the libraries."""

import hashlib
import random
import struct

import public_tokenizers as P
import pytest

from graphloom.llm import byte_bpe, token_counts

PATHS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.coder(*PATHS).ranks, special_tokens={})


def noise(n):
    rng = random.Random(2)
    alphabet = "aab  bcé日▁<s>0x41\t\n①the in on er  <0x0A> <|endoftext|> 's"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_bpe_is_the_library(library):
    texts = [*noise(500), "a" * 1000, "ab" * 700, " " * 400 + "x", "日" * 300]
    c = byte_bpe.coder(*PATHS)
    for t, (ids, decoded) in zip(texts, c.encode(texts), strict=True):
        want = library.encode_ordinary(t)
        assert ids == struct.pack(f"<{len(want)}I", *want) and decoded == t.encode()


def test_bpe_table(spark, odd_docs, odd_texts, no_docs, library):
    got = {r.doc_id: r for r in byte_bpe.digests(odd_docs, *PATHS).collect()}
    for i, t in odd_texts:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    enc = byte_bpe.encode(odd_docs, *PATHS)
    back = {r.doc_id: r.text for r in byte_bpe.decode(enc, *PATHS).collect()}
    assert back == {i: t or "" for i, t in odd_texts}
    assert byte_bpe.digests(no_docs, *PATHS).count() == 0


def test_counts_are_the_library(odd_docs, odd_texts, no_docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.merger(path)
    for t in [*noise(500), "a" * 2000, " " * 3000 + "x", "▁▁a", "ab" * 900]:
        assert m.text(t) == len(sp.encode(t))
    got = {r.doc_id: r for r in token_counts.token_counts(odd_docs, path, limit=100).collect()}
    for i, t in odd_texts:
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100)
    assert token_counts.token_counts(no_docs, path).count() == 0


def test_slices_of_long_texts(monkeypatch):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    monkeypatch.setattr(token_counts, "SLICE", 50)
    t = " ".join(noise(40))
    assert token_counts.merger(path).text(t) == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    c = byte_bpe.Coder(*PATHS)
    for t in noise(60):
        ((ids, _),) = c.encode([t])
        assert len(ids) // 4 == len(library.encode_ordinary(t))
