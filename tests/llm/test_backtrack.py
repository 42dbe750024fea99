"""The backtracking BPE encoder against plain merging and the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import messy
from chartfold.llm import backtrack_bpe as bpe
from chartfold.llm.queries import QUERIES, WORD_MODEL, table

TEXTS = st.lists(st.sampled_from([
    "a", "b", "aa", "the", "in", "ing", "é", "É", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "<|end", "'s", "'LL", "1", "½",
    " ", "\n", "\x1c", "\x85", "́", "İ", "執", "🙂", "#", "==", "..", "!!!!", "th", "er", "\x00", "Ａ", "ﬁ", "𢡊", "ᲊ",
]), max_size=20).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_MODEL)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(WORD_MODEL)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())


def test_any_merges_of_a_small_alphabet():
    """Merges made at random, tokens that their own bytes never give among them."""
    letters = bpe.byte_letters()
    for seed in range(60):
        rng = random.Random(seed)
        tokens = [letters[ord(c)] for c in "abc"]
        pairs = []
        for _ in range(rng.randint(1, 25)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                pairs.append((a, b))
                tokens.append(a + b)
        vocab = {c: i for i, c in enumerate(letters)} | {a + b: 256 + i for i, (a, b) in enumerate(pairs)}
        made = bpe.Merges(vocab, [list(p) for p in pairs])

        def slow(text):
            parts = list(text)
            while True:
                found = [(r, i) for i in range(len(parts) - 1) for r, p in enumerate(pairs) if (parts[i], parts[i + 1]) == p]
                if not found:
                    return [vocab[p] for p in parts]
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        for _ in range(60):
            text = "".join(rng.choices("abc", k=rng.randint(0, 24)))
            assert made.encode(text) == slow(text), (pairs, text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_texts_as_the_library(library, own, text):
    tokens, at = own.encode([text, None, text])
    data, upto = bpe.decoder(WORD_MODEL).decode(tokens.astype(np.int64), at)
    want = library.encode(text, add_special_tokens=False).ids
    assert tokens.tolist() == want + want and at.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert data[: upto[1]].tobytes().decode() == library.decode(want, skip_special_tokens=False)
    assert upto[1] == upto[2] and upto[3] == 2 * upto[1] == len(data)


def test_every_character_of_the_basic_plane(library, own):
    points = [p for p in range(0x10000) if not 0xD800 <= p <= 0xDFFF]
    for k in range(0, len(points), 64):
        text = "".join(f"a{chr(p)}b1 {chr(p)} " for p in points[k : k + 64])
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, hex(points[k])


def test_very_long_words_take_linear_time(library, own):
    text = "ab" * 50_000 + "=" * 50_000 + "😀" * 5_000
    assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_and_pairs_are_renewed(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORDS_KEPT_BYTES", 1)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 2)
    small = bpe.Encoder(WORD_MODEL)
    for text in ["the old river", "the bank of the river", "", "old<|endoftext|>"] * 2:
        assert small.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(small.known) < 12


def test_query_on_all_documents(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_bpe_encoding"](spark, sf).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_hard_rows(spark, library):
    df = messy(spark)
    coded = bpe.decode(bpe.encode(df, WORD_MODEL), WORD_MODEL)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, sha(r.decoded.encode())) for r in coded.collect())
    assert got == sorted((r.doc_id or -1, *expected(library, r.text)) for r in df.collect())
    assert bpe.decode(bpe.encode(df.limit(0), WORD_MODEL), WORD_MODEL).collect() == []


def test_decode_keeps_other_columns(spark, library):
    df = spark.createDataFrame([([320], "x", 1), ([], "y", 2), (None, "z", 3)], "ids array<int>, Decoded string, text int")
    got = {(tuple(r.ids or ()), r.text, r.decoded) for r in bpe.decode(df, WORD_MODEL).collect()}
    assert {r[1:] for r in got} == {(1, "a</w>"), (2, ""), (3, "")}
    with pytest.raises(Exception, match="token is null"):
        bpe.decode(df.select(F.array(F.lit(None).cast("int")).alias("ids")), WORD_MODEL).collect()
