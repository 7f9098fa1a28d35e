"""Shared column helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space: the six characters of [\x20\x09-\x0D], which bytes.split() splits on.
WHITE = b" \t\n\x0b\x0c\r"
# One process holds at most about so many bytes of joined texts at a time.
SLICE_BYTES = 4 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# Lower-cases A-Z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and any characters beyond ASCII."""
    return text.translate(_FOLD).split()


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a value's text form modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, with the text as bytes in ``_utf8``."""
    return docs.select(*columns, utf8().alias("_utf8"))


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with at most ``most`` bytes, or one longer text."""
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > most:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
