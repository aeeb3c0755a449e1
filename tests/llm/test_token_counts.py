"""Token counts against the tokenizers library, whole texts and chunks of all sizes."""

import random

import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolex.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "re", "a", "word", " the", "é", "漢字", "。", "😀", "12", "!", "...", "<|endoftext|>", "<|endof", "text|>", " ", "　", "\x1c", "ſ", "́", "ǅ", "٣", "​"]


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(2, 40), st.integers(1, 39))
def test_chunks_of_any_size(pieces, chunk, overlap):
    text = "".join(pieces)
    assert tc.counter(PATH, chunk, min(overlap, chunk - 1))(text) == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80), st.integers(2, 20))
def test_any_characters(text, chunk):
    assert tc.counter(PATH, chunk, 1)(text) == expected(text)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000, "漢" * 20_000, "ab " * 20_000, "'" * 9000, "<|endoftext|>" * 3000, "a" * 5000 + " b" * 5000 + "!" * 5000], ids=lambda t: t[:3])
def test_texts_without_borders(text):
    """An overlap without a stable place is widened, and nothing is encoded more than a few times."""
    count = tc.TokenCounter(tc.encoder(PATH), tc.counter(PATH, 2, 1).sizes, ["<|endoftext|>"], 256, 16)
    seen = []
    count.encode = lambda t, e=count.encode: seen.append(len(t)) or e(t)
    assert count(text) == expected(text)
    assert sum(seen) < 4 * len(text) + 4 * 256


def test_every_stable_place_is_a_border():
    """By brute force: with any text before and after, a token ends at each place called stable."""
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choices(PIECES, k=rng.randrange(2, 9)))
        ends = {e for _, e in LIBRARY.encode(text, add_special_tokens=False).offsets}
        for at in range(1, len(text)):
            if tc.stable(text, at, ["<|endoftext|>"]):
                assert at in ends, (text, at)
                assert expected(text[:at]) + expected(text[at:]) == expected(text)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {i: (len(t.encode()), expected(t), expected(t) > 512) for i, t in texts.items()}
    assert {r[0]: tuple(r)[1:] for r in tc.op13_token_counts(spark, SF).collect()} == want
    assert {r[0]: tuple(r)[1:] for r in tc.token_counts(docs, chunk=300, overlap=5).collect()} == want
    assert any(v[2] for v in want.values()) and not all(v[2] for v in want.values())


def test_awkward(awkward, empty):
    assert tc.token_counts(empty).count() == 0
    rows = sorted(map(repr, map(tuple, tc.token_counts(awkward, chunk=1000).collect())))
    assert rows == sorted(repr((r.doc_id, len((r.text or "").encode()), expected(r.text or ""), expected(r.text or "") > 512)) for r in awkward.collect())
