import random

import pytest

P = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from skylattice.llm import tokens  # noqa: E402
from tests.llm.cases import DOCS, docs  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = tokens.counter(PATH)
ALPHABET = list("ab cdE  \n\t'sretl0129.,!#äéß中文😀 \u0085\x1c​_ſ²½") + ["<|endoftext|>", "'ll", "the ", " ing"]


def _library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
def test_counts(text):
    assert OWN.count(text) == _library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    assert OWN.count(text) == _library(text)


def test_every_prefix():
    r = random.Random(2)
    for _ in range(150):
        text = "".join(r.choices(ALPHABET, k=r.randrange(16)))
        assert OWN.prefix_counts(text) == [_library(text[:i]) for i in range(len(text) + 1)]


def test_truncation():
    text = "The quick brown fox jumps over the lazy dog, again and again."
    for budget in range(16):
        cut = OWN.truncate(text, budget)
        assert _library(cut) <= budget and (cut == text or all(_library(text[:i]) > budget for i in range(len(cut) + 1, len(text) + 1)))


def test_long_pieces():
    assert OWN.count("x" * 5000) == _library("x" * 5000)
    assert OWN.count("=" * 3001 + " " * 999) == _library("=" * 3001 + " " * 999)


def test_rows(spark):
    got = tokens.token_counts(docs(spark), PATH).collect()
    expected = [(i, len((t or "").encode()), _library(t or ""), _library(t or "") > 512) for i, t, *_ in DOCS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert tokens.token_counts(docs(spark, []), PATH).collect() == []
