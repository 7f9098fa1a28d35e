"""Nearest known vector for each query vector, by exact cosine similarity.

The work is laid out as a matrix product: known vectors in shards, queries in blocks, one task per
(block, shard) of bounded size. A task returns one row per query, its best in that shard, and a
small aggregation picks the best shard. Nothing is broadcast, no pair of vectors becomes a row.

Inside a task few pairs are multiplied out. All vectors are turned by one orthonormal basis, fit on
a sample, which puts most of what known vectors differ in into the first ``SKETCH`` coordinates. With
p for these and r for the length of the rest, no pair can be more similar than p.p' + r * r' (Cauchy
and Schwarz). The most promising known vector of each query gives a similarity to beat, and only
pairs whose bound reaches it, and the floor if there is one, are multiplied on all coordinates. The
result is exact for any basis; a poor one only leaves more pairs. Where many are left the whole
block is multiplied, as that is faster then.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.templates import UNKNOWN_ID
from faultline.operators.ordered import with_rank
from faultline.staging import stage

SHARD_ROWS = 16_384  # known vectors per task: 50 MB at 384 doubles
BLOCK_ROWS = 4_096  # query vectors per task
TIE_DECIMALS = 9  # equal similarities must tie in spite of rounding
SKETCH = 32
BASIS_SAMPLE = 2_048  # known vectors on the driver to fit the basis: 6 MB at 384 doubles

_MULTIPLY_ROWS = 256
_MULTIPLY_PAIRS = 8_192
_MARGIN = 1e-7  # more than rounding can add to a bound
_DENSE = 0.1  # share of pairs beyond which a whole block is multiplied


def nearest_known(
    queries: DataFrame,
    known: DataFrame,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    floor: float | None = None,
) -> DataFrame:
    """For each query (key, vec) the best known (event_id, vec): key, event_id, similarity.

    All vectors have unit length. Ties go to the lowest event_id in string order. Queries whose
    best similarity is below ``floor`` may be left out. Both inputs should be staged tables, since
    they are counted first.
    """
    blocks = max(1, math.ceil(queries.count() / block_rows))
    shards = max(1, math.ceil(known.count() / shard_rows))
    basis = fit_basis(known)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def best_in_shard(some_queries: pd.DataFrame, some_known: pd.DataFrame) -> pd.DataFrame:
        return _best_in_shard(some_queries, some_known, basis, floor)

    left = queries.select(
        "key", "vec", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    ).withColumn("shard", every(shards))
    right = known.select(
        "event_id", "vec", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard")
    ).withColumn("block", every(blocks))
    per_shard = (
        left.groupBy("block", "shard")
        .cogroup(right.groupBy("block", "shard"))
        .applyInPandas(best_in_shard, "key STRING, event_id STRING, similarity DOUBLE")
    )
    return per_shard.groupBy("key").agg(
        # Highest similarity, then lowest id: the minimum of (-similarity, id).
        F.min(F.struct((-F.col("similarity")).alias("minus"), F.col("event_id"))).alias("best")
    ).select(
        "key",
        F.col("best.event_id").alias("event_id"),
        (-F.col("best.minus")).alias("similarity"),
    )


def fit_basis(known: DataFrame, sample: int = BASIS_SAMPLE, size: int = SKETCH) -> np.ndarray | None:
    """Orthonormal columns that hold most of the known vectors, from at most ``sample`` of them.

    None if there are too few vectors or coordinates for a sketch to save anything.
    """
    rows = known.select("vec").orderBy(F.xxhash64("event_id"), "event_id").limit(sample).toPandas()
    if len(rows) <= size or len(rows["vec"].iloc[0]) < 4 * size:
        return None
    vectors = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    return np.linalg.svd(vectors, full_matrices=False)[2][:size].T.copy()


def _best_in_shard(
    queries: pd.DataFrame, known: pd.DataFrame, basis: np.ndarray | None, floor: float | None
) -> pd.DataFrame:
    if queries.empty or known.empty:
        return queries.iloc[:0][["key"]].assign(event_id="", similarity=0.0)
    known = known.sort_values("event_id")
    matrix = np.stack(known["vec"].to_numpy()).astype(np.float64)
    vectors = np.stack(queries["vec"].to_numpy()).astype(np.float64)
    row, at, similarity, _ = best_pairs(vectors, matrix, basis, floor)
    return pd.DataFrame(
        {
            "key": queries["key"].to_numpy()[row],
            "event_id": known["event_id"].to_numpy()[at],
            "similarity": similarity,
        }
    )


def best_pairs(
    queries: np.ndarray, known: np.ndarray, basis: np.ndarray | None, floor: float | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row of each query, of its best known vector, their similarity, and how many pairs were
    multiplied on all coordinates. The first of equally good known vectors wins."""
    sketch, rest = _sketched(known, basis)
    rows, best, similarities, multiplied = [], [], [], 0
    for start in range(0, len(queries), _MULTIPLY_ROWS):
        part = queries[start : start + _MULTIPLY_ROWS]
        open_pairs = None if basis is None else _open_pairs(part, known, sketch, rest, basis, floor)
        if open_pairs is None or len(open_pairs[0]) > _DENSE * len(part) * len(known):
            product = (part @ known.T).round(TIE_DECIMALS)
            row, at = np.arange(len(part)), product.argmax(axis=1)
            similarity = product[row, at]
            multiplied += product.size
        else:
            row, at = open_pairs
            product = np.concatenate(
                [np.empty(0)]
                + [
                    np.einsum("ij,ij->i", part[row[i : i + _MULTIPLY_PAIRS]], known[at[i : i + _MULTIPLY_PAIRS]])
                    for i in range(0, len(row), _MULTIPLY_PAIRS)
                ]
            ).round(TIE_DECIMALS)
            multiplied += len(row) + len(part)
            order = np.lexsort((at, -product, row))
            row, at, similarity = row[order], at[order], product[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
            row, at, similarity = row[first], at[first], similarity[first]
        rows.append(row + start)
        best.append(at)
        similarities.append(similarity)
    return np.concatenate(rows), np.concatenate(best), np.concatenate(similarities), multiplied


def _sketched(vectors: np.ndarray, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The first coordinates in the basis, and the length of what they leave out."""
    if basis is None:
        return vectors[:, :0], np.zeros(len(vectors))
    sketch = vectors @ basis
    return sketch, np.sqrt(np.maximum(0, (vectors**2).sum(axis=1) - (sketch**2).sum(axis=1)))


def _open_pairs(
    queries: np.ndarray,
    known: np.ndarray,
    sketch: np.ndarray,
    rest: np.ndarray,
    basis: np.ndarray,
    floor: float | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the query, row of the known vector) that may be the best of their query."""
    own, own_rest = _sketched(queries, basis)
    bound = own @ sketch.T + own_rest[:, None] * rest
    to_beat = np.einsum("ij,ij->i", queries, known[bound.argmax(axis=1)])
    if floor is not None:
        to_beat = np.maximum(to_beat, floor)
    return np.nonzero(bound >= to_beat[:, None] - _MARGIN)


def resolve_unmatched(
    unmatched: DataFrame, embeddings: DataFrame, min_similarity: float
) -> DataFrame:
    """Keep the neighbours of unmatched texts that are similar enough."""
    near = nearest_known(unmatched, embeddings, floor=min_similarity)
    return near.filter(F.col("similarity") >= min_similarity)


def resolve_events(
    events: DataFrame, embeddings: DataFrame, min_similarity: float
) -> DataFrame:
    """Map each (event_id, vec) to a known id: event_id, resolved_id, similarity.

    A known id is itself, with similarity 1. Any other goes to its nearest known vector, or to
    the unknown id if that is not similar enough; the similarity shows how near it was, and is
    0 if nothing is known.
    """
    known = embeddings.select("event_id")
    own = events.join(known, "event_id", "left_semi").select(
        "event_id", F.col("event_id").alias("resolved_id"), F.lit(1.0).alias("similarity")
    )
    strangers = stage(
        events.join(known, "event_id", "left_anti").select(F.col("event_id").alias("key"), "vec"),
        "strangers",
    )
    near = nearest_known(strangers, embeddings).withColumnRenamed("event_id", "near_id")
    similarity = F.coalesce("similarity", F.lit(0.0))
    others = strangers.select("key").join(near, "key", "left").select(
        F.col("key").alias("event_id"),
        F.when(similarity >= min_similarity, F.col("near_id"))
        .otherwise(F.lit(UNKNOWN_ID))
        .alias("resolved_id"),
        similarity.alias("similarity"),
    )
    return own.unionByName(others)


def embedding_index(embeddings: DataFrame) -> DataFrame:
    """Row of each known id in the embedding matrix, whose rows follow the id's string order."""
    ranked = with_rank(embeddings.select("event_id"), [F.col("event_id")], "row")
    return ranked.select("event_id", (F.col("row") - 1).alias("row"))
