"""Counting, encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallycell.llm import bpe_codec, token_counts, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
FIXED = ["", " ", "\n\t", "Hello  WORLD it's we'll 'S 'Re x'lls", "aaaaaaaaaaaaaaaaa", "!" * 999, "<|endoftext|>", "a<|endoftext|>B<|StartOfText|>",
         "<|startoftext|><|endoftext|> <|endoftext|", "ΣΑΣ Σ İstanbul ǅ ß ﬁ é é ẛ̣", "日本語テキスト 한국어 한국", "😀👨‍👩‍👧 x​z", "\x00\x1c\x1fa\x85b\xa0c d﻿",
         "1234567890 ½ Ⅷ ٣", "ab" * 3000, "the" * 500, "_-_-_==__", "x퟿"]
LETTERS = ["a", "b", "e", "t", "h", "i", "n", "s", "o", " ", "'", "s", "é", "ß", "!", "!", ".", "1", "ing", "the", "tion", "日", "A", "Σ", "́", "|", "<"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sample():
    rng = random.Random(7)
    return FIXED + ["".join(rng.choices(LETTERS, k=rng.choice([3, 9, 40, 300]))) for _ in range(3000)]


def test_encode_and_decode_as_the_library(library):
    own = bpe_codec.codec(PATH)
    for text in sample():
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got.tolist() == want, text
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_counts_as_the_library(library):
    bpe = word_bpe.load(PATH)
    table = token_counts.PairTable(bpe)
    for text in sample():
        pieces = list(dict.fromkeys(bpe.pieces(text)))
        counts = dict(zip(pieces, token_counts.piece_counts(pieces, bpe, table), strict=True)) if pieces else {}
        assert sum(counts[p] for p in bpe.pieces(text)) == len(library.encode(text, add_special_tokens=False).ids), text


def test_small_caches_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "KEPT", 3)
    own = bpe_codec.Codec(PATH)
    for text in FIXED:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_together_with_a_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "KEPT", 40)
    own, texts = bpe_codec.Codec(PATH), sample()
    for start in range(0, len(texts), 7):
        part = texts[start:start + 7]
        ids, cuts = own.encode_all(part)
        got = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == [library.encode(x, add_special_tokens=False).ids for x in part]
        assert len(own.words) <= 40 + sum(len(own.bpe.words(x)) for x in part)
        assert [x.decode() for x in own.decode_all(ids, cuts)] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_queries_on_odd_rows(spark, library):
    rows = [(1, "it's a test"), (1, "it's a test"), (None, "null id"), (4, None), (5, ""), (6, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    counts = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert counts == sorted(want, key=str)
    digests = {tuple(r) for r in bpe_codec.digests(docs, PATH).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in digests
    back = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).collect()
    assert sorted(len(r.text) for r in back) == sorted(len(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for _, t in rows)
    none = docs.filter("false")
    assert token_counts.count_tokens(none, PATH).count() == bpe_codec.digests(none, PATH).count() == 0
