"""Template embedding and vector expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.templates import WILDCARD

# The size and the feature weights of the hash embedding.
DIM = 384
PLACEHOLDER = "<VAR>"
WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]+")
WORD_TAG, WORD_WEIGHT = "w:", 1.0
TRIGRAM_TAG, TRIGRAM_WEIGHT = "3:", 0.3

Embedder = Callable[[Column], Column]


def embedding_text(template: Column) -> Column:
    """The template as the embedder reads it: wildcards become one readable token."""
    return F.replace(template, F.lit(WILDCARD), F.lit(PLACEHOLDER))


@lru_cache(maxsize=1 << 18)
def _slot(feature: str) -> tuple[int, int]:
    """Index and sign of a feature, from its 64-bit little-endian BLAKE2b hash."""
    code = int.from_bytes(blake2b(feature.encode("utf-8"), digest_size=8).digest(), "little")
    return code % DIM, 1 if code >> 63 else -1


def hash_vectors(texts: list[str]) -> np.ndarray:
    """Signed feature counts of the words and character trigrams, at unit length, one row a text.

    The features of all texts are numbered first, so each different one is hashed once. Trigrams
    are numbers, three code points each, and become strings only when they are hashed.
    """
    lows = [text.lower() for text in texts]
    words = [WORD.findall(low) for low in lows]
    rows = np.arange(len(lows))
    named = np.array([word for found in words for word in found], dtype=object)
    parts = [
        _cells(named, np.repeat(rows, [len(found) for found in words]), WORD_TAG, WORD_WEIGHT, str)
    ]
    owner = np.repeat(rows, [len(low) for low in lows])
    points = np.frombuffer("".join(lows).encode("utf-32-le"), "<u4").astype(np.int64)
    inside = owner[:-2] == owner[2:]
    grams = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside]
    parts.append(_cells(grams, owner[:-2][inside], TRIGRAM_TAG, TRIGRAM_WEIGHT, _trigram))
    at, signed = (np.concatenate(both) for both in zip(*parts))
    vectors = np.bincount(at, signed, minlength=len(lows) * DIM).reshape(-1, DIM)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(lengths > 0, lengths, 1)).astype(np.float32)


def _cells(
    features: np.ndarray, owner: np.ndarray, tag: str, weight: float, name: Callable
) -> tuple[np.ndarray, np.ndarray]:
    """For each feature its cell in the flat matrix of vectors and its signed weight."""
    which, different = pd.factorize(features)
    slots = np.array([_slot(tag + name(f)) for f in different.tolist()], np.int64).reshape(-1, 2)
    return owner * DIM + slots[which, 0], weight * slots[which, 1]


def _trigram(code: int) -> str:
    return "".join(chr((code >> shift) & 0x1FFFFF) for shift in (42, 21, 0))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: pa.Array) -> pa.Array:
    """``hash_vectors`` batch by batch; Spark SQL has no BLAKE2b. Run it on distinct texts."""
    vectors = hash_vectors(texts.to_pylist())
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * DIM
    return pa.ListArray.from_arrays(ends, vectors.ravel())


def embed_templates(
    df: DataFrame, template: str, embedder: Embedder = hash_embedding
) -> DataFrame:
    """Add vec, the unit-length embedding of a template column by any vectorised embedder.

    The UDF runs in a step of its own: Spark takes no Python UDF inside array functions.
    """
    raw = df.withColumn("vec", embedder(embedding_text(F.col(template))))
    return raw.withColumn("vec", l2_normalise(F.col("vec")))


def norm(vector: Column) -> Column:
    """Euclidean length, summed in double precision."""
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalise(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    length = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    return F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
