"""Chunks without a space, of many lengths, against the library, in bounded memory."""

import random
import tracemalloc

import public_tokenizers
import pytest

from quarrymill.llm.piece_merge import Pieces


@pytest.fixture(scope="module")
def pieces():
    return Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_long_chunks_equal_the_library(pieces):
    rng = random.Random(8)
    letters = ["abcdefghijklmnopqrstuvwxyz", "aab", "é日a😀", "0123456789", "=-#"]
    chunks = ["▁" + "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(40, 3000))) for _ in range(60)] + ["▁" + "a" * 50_000, "\n" + "the" * 400, "▁" * 700 + "x"]
    flat, counts = pieces.encode(chunks)  # encode() holds each chunk against the library
    assert counts.sum() == len(flat) and (counts > 0).all()


def test_a_chunk_of_a_million_letters_takes_bounded_memory(pieces):
    rng = random.Random(9)
    text = "▁" + "".join(rng.choices("etaoinshrdlu", k=1_000_000))
    symbols, _ = pieces.symbols([text])
    pieces.union_of  # noqa: B018 - made once for all chunks
    tracemalloc.start()
    merged = pieces.merge_one(symbols)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 150e6 and 0 < len(merged) < 700_000
