"""SimHash near-duplicates: links at two or fewer differing bits, found by pigeonring filtering.

The 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most ``RADIUS``
bits, then some start on the ring exists from where, for every length l, the first l segments
differ in at most l * RADIUS / SEGMENTS bits (the strong form of the principle). Budgets below
one mean equality, so the first ``EXACT`` segments of the chain are a join key: every distinct
fingerprint is filed under each start. Inside a bucket the longer chains are held to their
budgets, and only what is left has all 64 bits compared.

A bucket is compared inside one task, which returns a spanning forest of its links, never all
pairs. Buckets over ``BUCKET`` members do not go to a task: there, each fingerprint is filed
under itself with the bits masked that the budgets still allow to differ, and equal masked
values link to their minimum, which is exact and linear in the members.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked
like any other; repeated rows and exact copies share a fingerprint; documents without a doc_id
take part, but a component's id is the smallest doc_id that is not null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.texts import LOWER, unused, utf8
from faultline.staging import fits_broadcast, stage

BITS = 64
RADIUS = 2
SEGMENTS = 16
WIDTH = BITS // SEGMENTS
EXACT = -(-SEGMENTS // RADIUS) - 1  # segments whose budget is still below one bit
KEY_BITS = EXACT * WIDTH
SHINGLE = 3
SEED = 42
BUCKET = 4096
_NEAR = 32  # members of larger buckets are compared row against bucket
_HASHES = 1 << 16


def fingerprint(text: Column) -> Column:
    """SimHash of a column of UTF-8 bytes, as a signed 64-bit number."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype=np.int64)

    return hashed(text)


def simhash(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest, count, ones = xxhash.xxh64_digest, 0, np.zeros(BITS, np.int64)
    while part := [digest(joined[a:b], SEED) for _, (a, b) in zip(range(_HASHES), spans)]:
        count += len(part)
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        if len(part) < _HASHES:
            break
    return int(np.packbits(2 * ones > count).view(">i8")[0])


def simhash_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id."""
    prints = stage(docs.select("doc_id", fingerprint(utf8()).alias("fp")), "fingerprints")
    rooted = rooted_prints(prints, bucket)
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def rooted_prints(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each distinct fingerprint of ``prints`` (doc_id, fp): fp, first_id, root of its group."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    roots = components(links(distinct.select("fp"), bucket))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest doc_id, with the columns it came with.

    A group without any doc_id keeps one row; of equal rows with the kept doc_id one stays.
    """
    own, id_name, fp_name = (unused(docs, name) for name in ("_fp", "_chosen_id", "_chosen_fp"))
    marked = stage(docs.withColumn(own, fingerprint(utf8())), "marked-documents")
    prints = marked.select("doc_id", F.col(own).alias("fp"))
    order = F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "fp")
    chosen = (
        rooted_prints(prints)
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.first_id").alias(id_name), F.col("first.fp").alias(fp_name))
    )
    chosen = stage(chosen, "chosen-documents")
    if fits_broadcast(chosen):
        chosen = F.broadcast(chosen)
    same = (F.col(own) == F.col(fp_name)) & F.col("doc_id").eqNullSafe(F.col(id_name))
    kept = marked.join(chosen, same, "left_semi")
    repeated = kept.groupBy("doc_id", own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.select(*docs.columns)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) that connect exactly the distinct fingerprints ``fp`` within RADIUS bits."""
    filed = prints.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).cast("long").alias("start"), _rotated(F.col("fp"), s).alias("turned")
                    )
                    for s in range(SEGMENTS)
                ]
            )
        ).alias("chain")
    ).select("chain.*").withColumn(
        "key", F.shiftrightunsigned("turned", BITS - KEY_BITS).bitwiseOR(
            F.shiftleft("start", KEY_BITS)
        )
    )
    filed = stage(filed, "chains")
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sized = filed.join(shared, "key")
    compared = (
        sized.filter(F.col("members") <= bucket)
        .select("key", "start", "turned")
        .repartition("key")
        .sortWithinPartitions("key", "turned")
        .mapInPandas(_compare_buckets, "start long, a long, b long")
    )
    return (
        compared.unionByName(_masked_links(sized.filter(F.col("members") > bucket)))
        .select(*[_unrotated(F.col(c), F.col("start")).alias(c) for c in ("a", "b")])
        .distinct()
    )


def _rotated(value: Column, start: int) -> Column:
    turn = start * WIDTH
    if turn == 0:
        return value
    return F.shiftleft(value, turn).bitwiseOR(F.shiftrightunsigned(value, BITS - turn))


def _unrotated(value: Column, start: Column) -> Column:
    turns = [F.when(start == s, _rotated(value, (SEGMENTS - s) % SEGMENTS)) for s in range(SEGMENTS)]
    return F.coalesce(*turns)


def _compare_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch])
        last = rows["key"].iloc[-1] if len(rows) else None
        whole = (rows["key"] != last).to_numpy()
        held = rows[~whole]
        yield _forest(rows[whole])
    if held is not None:
        yield _forest(held)


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links inside the buckets of ``rows``, sorted by key."""
    key = rows["key"].to_numpy(np.int64)
    value = rows["turned"].to_numpy(np.int64).view(np.uint64)
    n = len(key)
    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]]) if n else [0]
    sizes = np.diff(bounds)
    left, right = [], []
    for apart in range(1, min(_NEAR, int(sizes.max(initial=1)))):
        i = np.flatnonzero(key[apart:] == key[:-apart])
        i = i[within_budgets(value[i], value[i + apart])]
        left.append(i)
        right.append(i + apart)
    for at in np.flatnonzero(sizes > _NEAR):
        lo, hi = bounds[at], bounds[at + 1]
        for i in range(lo, hi - _NEAR):
            j = np.arange(i + _NEAR, hi)
            j = j[within_budgets(value[i], value[j])]
            left.append(np.full(len(j), i))
            right.append(j)
    a = np.concatenate(left).astype(np.int64) if left else np.empty(0, np.int64)
    b = np.concatenate(right).astype(np.int64) if right else np.empty(0, np.int64)
    label = _smallest_labels(n, a, b)
    tied = np.flatnonzero(label != np.arange(n))
    return pd.DataFrame(
        {
            "start": rows["start"].to_numpy(np.int64)[tied],
            "a": value[tied].view(np.int64),
            "b": value[label[tied]].view(np.int64),
        }
    )


def within_budgets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chains from the first segment on: every prefix within its share, then all bits."""
    differing = a ^ b
    good = np.ones(differing.shape, bool)
    for length in range(EXACT + 1, SEGMENTS):
        prefix = differing >> np.uint64(BITS - length * WIDTH)
        good &= np.bitwise_count(prefix) <= length * RADIUS // SEGMENTS
    return good & (np.bitwise_count(differing) <= RADIUS)


def _smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _masks() -> list[int]:
    """Sets of RADIUS bits, past the exact part, that the budgets allow to differ."""
    free = range(BITS - KEY_BITS)
    allowed = []
    for bits in combinations(free, RADIUS):
        mask = sum(1 << bit for bit in bits)
        prefixes = range(EXACT + 1, SEGMENTS)
        if all(
            (mask >> (BITS - n * WIDTH)).bit_count() <= n * RADIUS // SEGMENTS for n in prefixes
        ):
            allowed.append(mask)
    return allowed


def _masked_links(members: DataFrame) -> DataFrame:
    masks = F.array(*[F.lit(mask).cast("long") for mask in _masks()])
    variants = members.select("key", "start", "turned", F.explode(masks).alias("mask")).withColumn(
        "rest", F.col("turned").bitwiseAND(F.bitwise_not("mask"))
    )
    keys = ["key", "mask", "rest"]
    least = variants.groupBy(*keys).agg(F.min("turned").alias("b"))
    return (
        variants.join(least, keys)
        .filter("turned <> b")
        .select("start", F.col("turned").alias("a"), "b")
        .distinct()
    )
