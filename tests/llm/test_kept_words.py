"""What a worker keeps: words between slices of texts, the state of one operator."""

from __future__ import annotations

import random

import pyarrow as pa

from rankwell.llm import bpe, common, tokenfiles
from rankwell.llm.queries import vocabulary_path


def test_words_outlast_a_slice():
    """A slice may hold 50,000 distinct words; what two slices share is encoded once, if in the same order or another."""
    rng, enc, calls = random.Random(2), tokenfiles.Encoder(vocabulary_path()), []
    own = enc.tokenize
    enc.tokenize = lambda w: calls.append(w) or own(w)
    words = list(dict.fromkeys("".join(rng.choices("abcdefghij", k=8)) for _ in range(50_000)))
    first = enc.encode_all(pa.array([" ".join(words)]))
    again = rng.sample(words, len(words))
    assert enc.encode_all(pa.array([" ".join(words)])).equals(first)
    enc.encode_all(pa.array([" ".join(again)]))
    assert len(calls) == len(words)
    assert first.values.to_pylist()[:200] == [i for w in words for i in enc.lib.encode(w, add_special_tokens=False).ids][:200]


def test_words_outlast_several_slices():
    """Three slices of 45,000 distinct words each, read twice: every word is encoded once, and to the same ids."""
    rng, enc, calls = random.Random(3), tokenfiles.Encoder(vocabulary_path()), []
    own = enc.tokenize
    enc.tokenize = lambda w: calls.append(w) or own(w)
    words = list({"".join(rng.choices("abcdefghij", k=8)) for _ in range(135_000)})
    slices = [pa.array([" ".join(words[k::3])]) for k in range(3)]
    first = [enc.encode_all(x) for x in slices]
    assert all(enc.encode_all(x).equals(y) for x, y in zip(slices, first))
    assert len(calls) == len(words) > 120_000


def test_a_worker_keeps_one_operators_state():
    """What encoding keeps goes when another operator's work begins, and only then."""
    one = bpe.vocabulary(vocabulary_path())
    assert bpe.vocabulary(vocabulary_path()) is one
    common.sole("another")
    assert bpe._vocabulary.cache_info().currsize == 0
    assert bpe.vocabulary(vocabulary_path()) is not one
