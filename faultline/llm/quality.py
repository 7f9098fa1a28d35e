"""Quality rules: word statistics, and zstandard ratios held against length-specific bands.

Repetitive text compresses too well, random text hardly at all. How well clean prose compresses
depends on its length, so each band of lengths has its own limits, for the whole document and
for fixed chunks of it, the last of which are its final bytes. A document is rejected when its whole ratio is outside its band, or when
too many of its chunks are outside the chunk limits.

Defined cases: a null or empty text has no words, fails the base rule and is not kept. Texts
shorter than the first band have no compression verdict, those shorter than a chunk only the whole one. Repeated rows are judged one by one, so
each gets the same verdict. Columns beside ``text`` are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.texts import WHITE, utf8

SYMBOLS = b"#*$%&|<>"
SHINGLE = 5
LEVEL = 3
CHUNK_BYTES = 2048
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_BAD_CHUNKS = 0.3


class Band(NamedTuple):
    """Limits of the compression ratio for texts of at least ``n_bytes``."""

    n_bytes: int
    low: float
    high: float


# Prose of these lengths measures 0.39 to 0.95; short texts pay the fixed cost of a frame. Random
# letters and digits measure 0.75 and more, repeated phrases under 0.3.
BANDS = (
    Band(128, 0.40, 1.05),
    Band(256, 0.42, 0.92),
    Band(512, 0.41, 0.82),
    Band(1024, 0.39, 0.74),
    Band(2048, 0.37, 0.70),
    Band(4096, 0.35, 0.68),
    Band(8192, 0.33, 0.66),
    Band(16384, 0.30, 0.66),
    Band(65536, 0.25, 0.66),
    Band(1 << 20, 0.20, 0.66),
)
CHUNK_BAND = Band(CHUNK_BYTES, 0.36, 0.70)

_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks double"
)
_NOT_WORD_CHAR = WHITE + bytes(range(0x80, 0xC0))


def quality(text: str = "text", bands: tuple[Band, ...] = BANDS) -> Column:
    """A struct of the statistics and the verdict on a text column."""

    @F.pandas_udf(_SCHEMA)
    def measure(texts: pd.Series) -> pd.DataFrame:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [_row(t, bands, compress) for t in texts]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _SCHEMA.split(", ")])

    return measure(utf8(text))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    return docs.select("doc_id", quality().alias("_q")).select("doc_id", "_q.*")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.filter(quality()["kept"])


def _row(text: bytes, bands: tuple[Band, ...], compress) -> tuple:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = repeat_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    ratio, bad = compression(text, compress)
    return (
        len(words),
        len(text.translate(None, _NOT_WORD_CHAR)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        base_failed,
        not base_failed and _inside(len(text), ratio, bands) and bad <= MAX_BAD_CHUNKS,
        ratio,
        bad,
    )


def compression(text: bytes, compress) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its chunks outside the chunk limits.

    The last chunk ends with the text and may overlap the one before, so chunks cover every byte.
    """
    if not text:
        return 0.0, 0.0
    starts = [*range(0, len(text) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if starts and len(text) % CHUNK_BYTES:
        starts.append(len(text) - CHUNK_BYTES)
    chunks = [len(compress(text[at : at + CHUNK_BYTES])) / CHUNK_BYTES for at in starts]
    outside = sum(not CHUNK_BAND.low <= c <= CHUNK_BAND.high for c in chunks)
    return len(compress(text)) / len(text), outside / max(1, len(chunks))


def _inside(n_bytes: int, ratio: float, bands: tuple[Band, ...]) -> bool:
    own = [band for band in bands if band.n_bytes <= n_bytes]
    return not own or own[-1].low <= ratio <= own[-1].high


def repeat_words(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Words inside windows of ``shingle`` words that occur more than once among the words."""
    n = len(words)
    if n <= shingle:
        return 0
    numbers = {word: at for at, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    windows = n - shingle + 1
    codes, bound = ids[:windows], len(numbers)
    for step in range(1, shingle):
        if bound * len(numbers) >= 1 << 62:  # number the prefixes densely before they overflow
            codes = np.unique(codes, return_inverse=True)[1]
            bound = windows
        codes = codes * len(numbers) + ids[step : step + windows]
        bound *= len(numbers)
    _, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + shingle, -1)
    return int(np.count_nonzero(np.cumsum(change)))
