"""Byte-level encoding by columns: no work of Python's a chunk, a bounded cache, the library's ids."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm.chunks import ChunkEncoder, Columns, tokenizer_path
from tokenizers import Tokenizer

BYTE = tokenizer_path("byte_bpe_50k.json")


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdeghilnorst", k=8)) + rng.choice(["", "", ",", ".", "!)"]) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_calls_do_not_follow_distinct_chunks(library):
    """20,000 distinct chunks, each of which took several calls once, when it was learnt and when it was looked up."""
    texts, calls = [" ".join(words(1000, seed)) for seed in range(20)], [0]
    encode = ChunkEncoder(BYTE).encode
    encode([" ".join(words(500, 99)).encode()])  # what is imported late

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = encode([t.encode() for t in texts])
    finally:
        sys.setprofile(None)
    assert got == library(texts)
    assert calls[0] < 5000


def test_mixed_batches(library):
    """Texts cut at single spaces, others, empty ones and special tokens in one batch, in every order; punctuation behind letters of one and two bytes."""
    pieces = ["x,", "é.", "Ã×!", "÷.", "ö--", "l'été", "<|endoftext|>", "a<|b", "<", "...", "two  spaces", " ", "\n", "a\nb", "日本。", "日本,", "\xa0x", "\x85", "\x00"]
    rng = random.Random(3)
    encoders = [ChunkEncoder(BYTE), ChunkEncoder(BYTE, 7)]
    for _ in range(200):
        texts = [rng.choice(["", " "]).join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(rng.randrange(12))]
        for e in encoders:
            assert e.encode([t.encode() for t in texts]) == library(texts)


def test_columns_stay_bounded():
    """Never more than the limit, no long keys; of a full cache those stay that were used most."""
    columns, asked = Columns(100), []

    def learn(keys: pa.Array):
        asked.extend(keys.to_pylist())
        sizes = np.array([len(k) % 3 + 1 for k in keys.to_pylist()], np.int32)
        ids = np.concatenate([np.full(n, int(k[:6]), "<u4") for k, n in zip(keys.to_pylist(), sizes)])
        return ids, np.cumsum(sizes, dtype=np.int32) - sizes, sizes

    for turn in range(30):
        often = [b"%06d" % i for i in range(20)]
        rare = [b"%06d" % i + b"x" * (i % 5) for i in range(1000 + 40 * turn, 1040 + 40 * turn)] + [b"%06d" % turn + b"y" * 200]
        ids, begins, sizes = columns.values(pa.array(often + rare, pa.binary()), learn)
        for key, at, n in zip(often + rare, begins.tolist(), sizes.tolist()):
            assert n == len(key) % 3 + 1 and (ids[at : at + n] == int(key[:6])).all()
        assert len(columns.keys) == len(columns.sizes) == len(columns.uses) <= 100 and len(columns.pool) == columns.sizes.sum()
    assert max(map(len, columns.keys.to_pylist())) <= Columns.LONGEST
    assert sum(k in often for k in asked) == len(often)
    many = [b"%06d" % i for i in range(5000, 5300)]
    assert len(columns.values(pa.array(many, pa.binary()), learn)[1]) == 300 and len(columns.keys) <= 100
