"""Merge replay against the tokenizer library, and as an exact round trip."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.queries import VOCABULARY
from tidelog.llm.tokenize import Encoder, byte_alphabet, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "", " ", "\n", "  two  spaces\t\ttabs \n\n end ", "<|endoftext|> is text", "I'll we've don't it's THEY'RE 's", "a" * 20_000, "ab" * 5000, "été" * 900,
    "½ ²³ Ⅷ ١٢ 12345678901234567890", "\x1c\x1d \x85 \u00a0 \u3000\u2009x\u200b", "日本語の短い文です。", "👩‍🚀🚀 → ∑ ≠ ǆ", "\ufeff\u180e\x00", "İstanbul ﬁle", "\\n\u2028line",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


def lists(encoder, texts):
    ids, sizes = encoder.encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    assert at == len(ids)
    return out


def test_odd_texts(encoder, library):
    assert lists(encoder, ODD) == [library(t) for t in ODD]
    # Every word is known now; the answer stays.
    assert lists(encoder, ODD[::-1]) == [library(t) for t in ODD[::-1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(encoder, library, texts):
    assert lists(encoder, texts) == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aehilnorst '1", max_size=400))
def test_dense_merges_and_round_trip(encoder, library, text):
    ids = lists(encoder, [text])[0]
    assert ids == library(text)
    names = {i: t for t, i in json.load(open(VOCABULARY))["model"]["vocab"].items()}
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    assert bytes(byte[c] for i in ids for c in names[i]).decode() == text


def test_small_memory_forgets_and_stays_right(library):
    small = Encoder(VOCABULARY, known_words=5)
    r = random.Random(1)
    for _ in range(20):
        texts = ["".join(r.choices("abcdefgh ", k=200)) for _ in range(3)]
        assert lists(small, texts) == [library(t) for t in texts]


def test_corpus_of_any_cut(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (100, None, "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    for block in (1, 50, 10**7):
        got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, VOCABULARY, block_chars=block).collect()), key=str)
        assert got == sorted(((i, library(t)) for i, t, _ in rows), key=str)
    assert encode_corpus(df.limit(0), VOCABULARY).count() == 0
