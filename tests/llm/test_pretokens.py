"""Encoding by pre-tokens against encoding whole texts."""

import random

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.pretokens import LETTERS, Encoder, load, pretokens, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TOKENIZER, ENCODER = load(PATH), Encoder(PATH)


def both(text):
    import numpy as np

    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), ENCODER.kind).tolist() == want, repr(text)
    assert sum(len(TOKENIZER.encode(x, add_special_tokens=False).ids) for c in text.encode().split() for x in pretokens(c)) == len(want), repr(text)


def test_sample():
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        both(r["text"])


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    both(text)


def test_every_character_and_neighbours():
    rng = random.Random(1)
    pool = [chr(i) for i in range(0x250)] + list("‘’“”–—…€ſﬁ̇́ 　 日本ЖжΣς'") + ["'s", "'LL", "<|endoftext|>", "<|", "|>", *LETTERS]
    for _ in range(3000):
        both("".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))))
    for i in range(0x3000):
        if not 0xD800 <= i < 0xE000:
            both(f"a{chr(i)}b {chr(i)}{chr(i)}'s")
