"""Chunks of the quality rules cover every byte."""

import random

import pytest
import zstandard

from faultline.llm import quality
from tests.llm.test_texts import _sentence

compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress


@pytest.mark.parametrize("tail", ["repeated", "noise"])
def test_a_bad_tail_has_a_chunk_of_its_own(tail):
    rng = random.Random(7)
    prose = _sentence(rng, 3000)[:2100].encode()
    ends = {
        "repeated": b"the very same words come back " * 70,
        "noise": " ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(200)).encode(),
    }
    assert quality.compression(prose, compress)[1] == 0
    text = prose + ends[tail][:1990]
    assert len(text) < 2 * quality.CHUNK_BYTES
    assert quality.compression(text, compress)[1] == 0.5
    assert not quality._row(text, quality.BANDS, compress)[6]


def test_chunks_of_texts_around_their_size():
    for size in (1, 2047, 2048, 2049, 4095, 4096, 4097):
        seen = []
        quality.compression(bytes(size), lambda part: seen.append(len(part)) or b"")
        chunks = seen[:-1]  # the whole text comes last
        assert sum(chunks) >= size if size >= 2048 else not chunks
        assert all(n == 2048 for n in chunks) and len(chunks) == (-(-size // 2048) if size >= 2048 else 0)
