import sys
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import vectors as vec
from faultline.operators import ordered
from faultline.operators.neighbours import (
    best_pairs,
    embedding_index,
    fit_basis,
    nearest_known,
    resolve_events,
    resolve_unmatched,
)
from faultline.operators.ordered import with_rank

KNOWN = "event_id STRING, vec ARRAY<FLOAT>"
QUERY = "key STRING, vec ARRAY<FLOAT>"


def by_hand(text):
    """The embedding from its description: words count 1, trigrams 0.3, sign from the top bit."""
    import re

    low, out = text.lower(), [0.0] * 384
    words = [("w:" + w, 1.0) for w in re.findall("[a-z_][a-z_0-9]+", low)]
    for name, weight in words + [("3:" + low[i : i + 3], 0.3) for i in range(len(low) - 2)]:
        digest = blake2b(name.encode(), digest_size=8).digest()[::-1].hex()
        code = int(digest, 16)
        out[code % 384] += weight if code >= 1 << 63 else -weight
    size = sum(x * x for x in out) ** 0.5
    return [x / size if size else x for x in out]


@pytest.mark.parametrize("text", ["link <*> down", "A b", "", "état Ωmega_9 <*>", "<*> <*>"])
def test_hash_embedding(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    got = vec.embed_templates(df, "t").first()["vec"]
    assert len(got) == vec.DIM
    assert np.allclose(got, by_hand(text.replace("<*>", "<VAR>")), atol=1e-6)


def test_placeholder_counts_as_the_word_var():
    assert np.allclose(vec.hash_vectors(["<VAR>"])[0], by_hand("<var>"), atol=1e-6)


def test_l2_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v ARRAY<FLOAT>")
    got = [r[0] for r in df.select(vec.l2_normalise(F.col("v"))).collect()]
    assert np.allclose(got, [[0.6, 0.8], [0.0, 0.0]])


def unit(rng, n, dim=16):
    m = rng.normal(size=(n, dim)).astype(np.float32)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(16_384, 16_384), (7, 11)])
def test_nearest_equals_brute_force(spark, shard_rows, block_rows):
    rng = np.random.default_rng(1)
    known, queries = unit(rng, 60), unit(rng, 50)
    known[40] = known[3]  # a tie: the lower id has to win
    queries[0] = known[3]
    got = nearest_known(
        spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(queries)], QUERY),
        spark.createDataFrame([(f"E{i:04d}", v) for i, v in enumerate(known)], KNOWN),
        shard_rows,
        block_rows,
    ).collect()
    product = (np.array(queries) @ np.array(known).T).round(9)
    assert {r["key"]: (r["event_id"], round(r["similarity"], 6)) for r in got} == {
        f"q{i}": (f"E{row.argmax():04d}", round(row.max(), 6)) for i, row in enumerate(product)
    }
    assert {r["key"]: r["event_id"] for r in got}["q0"] == "E0003"


def log_templates(rng, n):
    parts = [
        ["link", "modem", "disk", "wifi", "usb", "camera", "sensor", "relay"],
        ["open", "close", "reset", "probe", "scan", "sync", "mount"],
        ["channel", "port", "device", "slot", "unit", "bank"],
        ["timeout", "error <*>", "code <*>", "retry", "abort <*> after <*>"],
        ["up", "down", "idle", "unknown", "busy"],
    ]
    names = {"{} {} failed on {} with {} state={}".format(*(rng.choice(p) for p in parts)) for _ in range(n)}
    return vec.hash_vectors(sorted(names)).astype(np.float64)


@pytest.mark.parametrize("floor", [None, 0.55, 0.97])
@pytest.mark.parametrize("kind", ["templates", "random", "few"])
def test_pruned_pairs_are_the_best_pairs(kind, floor):
    rng = np.random.default_rng(4)
    if kind == "templates":
        every = log_templates(rng, 9000)
        every = every[rng.permutation(len(every))]
        known, queries = every[400:], np.concatenate([every[:400], -every[:3], np.zeros((1, 384))])
        known[70] = known[12]
        queries[5] = known[12]
    else:
        size = 300 if kind == "random" else 40
        known, queries = np.array(unit(rng, size, 384)), np.array(unit(rng, 50, 384))
    size = 32 if kind != "few" else 8
    basis = np.linalg.svd(known[:500], full_matrices=False)[2][:size].T
    row, at, similarity, multiplied = best_pairs(queries, known, basis, floor)
    product = (queries @ known.T).round(9)
    best = product.max(axis=1)
    kept = np.isin(np.arange(len(queries)), row)
    assert (best[~kept] < (-2 if floor is None else floor)).all()
    assert (similarity == best[row]).all() and (at == product.argmax(axis=1)[row]).all()
    if kind == "templates":
        # All coordinates of one pair in a hundred, and a twelfth of those of the others.
        assert multiplied < 0.01 * product.size


def test_basis_comes_from_a_bounded_sample(spark):
    rng = np.random.default_rng(5)
    known = spark.createDataFrame([(f"E{i}", v) for i, v in enumerate(unit(rng, 200, 256))], KNOWN)
    basis = fit_basis(known, sample=50, size=8)
    assert basis.shape == (256, 8) and np.allclose(basis.T @ basis, np.eye(8))
    assert fit_basis(known.limit(5), size=8) is None  # fewer vectors than coordinates
    assert fit_basis(known, size=100) is None  # coordinates too few for a sketch to save work


def test_nearest_of_templates_in_shards(spark):
    rng = np.random.default_rng(6)
    every = log_templates(rng, 1200)
    every = every[rng.permutation(len(every))].astype(np.float32)
    known, queries = every[60:], every[:60]
    got = nearest_known(
        spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], QUERY),
        spark.createDataFrame([(f"E{i:04d}", v.tolist()) for i, v in enumerate(known)], KNOWN),
        400,
        25,
        floor=0.55,
    ).collect()
    product = (queries.astype(float) @ known.astype(float).T).round(9)
    assert {(r["key"], r["event_id"], r["similarity"]) for r in got} == {
        (f"q{i}", f"E{row.argmax():04d}", row.max()) for i, row in enumerate(product) if row.max() >= 0.55
    }


def test_similarity_floor(spark):
    known = spark.createDataFrame([("E0000", [1.0, 0.0])], KNOWN)
    queries = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [0.5, 0.75**0.5])], QUERY)
    got = resolve_unmatched(queries, known, 0.55).collect()
    assert [(r["key"], r["event_id"]) for r in got] == [("a", "E0000")]


def test_nothing_known(spark):
    known = spark.createDataFrame([], KNOWN)
    queries = spark.createDataFrame([("a", [0.6, 0.8])], QUERY)
    assert nearest_known(queries, known).count() == 0


def test_resolve(spark):
    known = spark.createDataFrame([("E0000", [1.0, 0.0]), ("E0001", [0.0, 1.0])], KNOWN)
    events = spark.createDataFrame(
        [("E0001", [1.0, 0.0]), ("a", [0.6, 0.8]), ("b", [-0.6, -0.8])], KNOWN
    )
    got = {
        r["event_id"]: (r["resolved_id"], round(r["similarity"], 6))
        for r in resolve_events(events, known, 0.55).collect()
    }
    assert got == {"E0001": ("E0001", 1.0), "a": ("E0001", 0.8), "b": ("<unk>", -0.6)}
    nothing = spark.createDataFrame([], KNOWN)
    assert {r["similarity"] for r in resolve_events(events, nothing, 0.55).collect()} == {0.0}


def test_ranks_of_ids_with_a_common_prefix_come_from_all_tasks(spark):
    ids = [f"E{i * 7919 % 100_000:06d}" for i in range(100_000)]
    df = spark.createDataFrame([(i,) for i in ids], "event_id STRING")
    ranked = with_rank(df, [F.col("event_id")], "row", parts=8)
    got = ranked.toPandas()
    assert dict(zip(got["event_id"], got["row"])) == {v: i for i, v in enumerate(sorted(ids), 1)}
    ranges = ordered._in_ranges(df, [F.col("event_id")], 8).groupBy("_range").count()
    sizes = [r["count"] for r in ranges.collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 100_000 / 8


def test_ranks_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "k STRING, v INT")
    got = with_rank(df, [F.col("k").asc_nulls_first(), F.col("v").desc()], "n", parts=3).collect()
    assert sorted((r["n"], r["v"]) for r in got) == [(1, 4), (2, 2), (3, 3), (4, 1)]
    assert with_rank(df.limit(0), [F.col("k")], "n").count() == 0


def test_matrix_rows_follow_string_order(spark):
    ids = ["E0002", "E10000", "E9999", "E0001", "E1000"]
    got = embedding_index(spark.createDataFrame([(i, [1.0]) for i in ids], KNOWN)).collect()
    assert {r["event_id"]: r["row"] for r in got} == {v: i for i, v in enumerate(sorted(ids))}


def feature_by_feature(texts):
    """Slots and weights of all texts, each feature a string of its own."""
    out = np.zeros((len(texts), vec.DIM))
    for row, text in enumerate(texts):
        low = text.lower()
        words = [("w:" + w, 1.0) for w in vec.WORD.findall(low)]
        for name, weight in words + [("3:" + low[i : i + 3], 0.3) for i in range(len(low) - 2)]:
            slot, sign = vec._slot(name)
            out[row, slot] += weight * sign
    return out


def test_hashing_does_no_python_step_per_trigram():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeé_1\U0001d4b3"), 7)) for _ in range(200)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(1_000)] + ["", "a", "ab", "abc"]
    want = feature_by_feature(texts)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vec.hash_vectors(texts), want, atol=1e-6)
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += 1

    # Calls of list and dict methods count as well.
    sys.setprofile(count)
    try:
        vec.hash_vectors(texts)
    finally:
        sys.setprofile(None)
    assert steps < sum(map(len, texts)) / 10
