"""Suffix dedup, line dedup, SimHash groups and components against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import line_dedup, simhash, suffix_dedup
from faultline.llm.components import components
from tests.llm import plain

EMPTY = "doc_id long, text string"


def _prose(rng, words, letters="abcdeéß"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(words))


def _documents(seed, count=40):
    rng = random.Random(seed)
    passages = [_prose(rng, rng.randint(10, 60)) for _ in range(6)]
    lines = [_prose(rng, rng.randint(1, 30)) for _ in range(8)]
    docs = []
    for i in range(count):
        parts = []
        for _ in range(rng.randint(0, 8)):
            kind = rng.random()
            text = rng.choice(passages) if kind < 0.3 else _prose(rng, rng.randint(1, 20))
            if kind > 0.5:
                text = "\n" + rng.choice(lines) + rng.choice(["\n", "\n\n", "\n  \n"])
            at = rng.randint(0, 12)
            parts.append(text[at:] if kind < 0.1 else text)
        docs.append((i, rng.choice(["", " "]).join(parts)))
    for i in range(count, count + 8):
        old = docs[rng.randrange(count)][1]
        at = rng.randint(0, len(old))
        docs.append((i, rng.choice([old, old[:at] + "x" + old[at:], old[at:] + old[:at]])))
    docs += [(count + 8, None), (count + 9, ""), (count + 10, "ab" * 400), (count + 11, "\n\n \n")]
    docs.append((count + 12, _prose(rng, 40) * 9))
    rng.shuffle(docs)
    return docs


def _removed(df):
    rows = df.withColumn("digest", F.sha2("kept", 256)).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["digest"]) for r in rows}


@pytest.mark.parametrize("seed, part, hot", [(1, 10**6, 10**5), (2, 50, 10**5), (3, 50, 2)])
def test_suffix_dedup_removes_what_started_earlier(spark, monkeypatch, seed, part, hot):
    monkeypatch.setattr(suffix_dedup, "BUCKET_CONTEXTS", part)
    docs = _documents(seed)
    df = plain.documents(spark, docs).repartition(4)
    found = _removed(suffix_dedup.remove_repeats(df, hot))
    assert found == plain.removed_strings(docs)


def test_suffix_dedup_of_a_text_longer_than_a_buffer(spark):
    rng = random.Random(5)
    block = "".join(rng.choices("abcdefgh", k=700_000))
    docs = [(1, block + "!" + block[5000:6000]), (2, "?" + block[600_000:] + block[:10])]
    found = _removed(suffix_dedup.remove_repeats(plain.documents(spark, docs)))
    assert found[1][:3] == (701_001, 1000, 1)
    assert found[2][:3] == (100_011, 100_000, 1)


def test_suffix_dedup_of_repeated_rows_nulls_and_nothing(spark):
    text = "".join(random.Random(6).choices("abcdef", k=300))
    rows = [(None, text), (7, text + "-"), (7, text + "-"), (7, "other " + text), (9, None)]
    found = suffix_dedup.remove_repeats(plain.documents(spark, rows)).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in found)
    assert got == [(False, 0, 0), (True, 7, 300), (True, 7, 300), (True, 7, 300), (True, 9, 0)]
    none = suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY))
    assert none.count() == 0


def test_interleave_equals_sorting_all_suffixes():
    rng = np.random.default_rng(3)
    shards, texts = [], []
    for _ in range(4):
        sizes = rng.integers(1, 12, 15)
        words = rng.integers(1, 4, sizes.sum()).astype(np.uint64)
        shards.append((suffix_dedup.transform(words, sizes), sizes))
        strings = np.split(words.tolist(), np.cumsum(sizes)[:-1])
        texts.append([list(map(int, s)) for s in strings])
    rounds = 6
    order, common = suffix_dedup.interleave(shards, rounds)
    suffixes = []
    for (shard, _), strings in zip(shards, texts):
        flat = [s[at:] for s in strings for at in range(len(s) + 1)]
        suffixes += [flat[place] for place in shard["place"]]
    merged = [suffixes[i][:rounds] for i in order]
    assert merged == sorted(merged)
    for at in range(1, len(merged)):
        a, b = suffixes[order[at - 1]], suffixes[order[at]]
        same = 0
        while same < min(len(a), len(b), rounds) and a[same] == b[same]:
            same += 1
        if same < min(len(a), len(b)) or same == rounds:
            assert common[at] == same


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_and_longest_runs(spark, seed):
    docs = _documents(seed, 30)
    docs += [(100, docs[3][1]), (101, f"{docs[3][1]}\n{docs[4][1]}")]
    df = plain.documents(spark, docs).repartition(3)
    expected = plain.line_dedup(docs)
    found = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    assert {i: (r["kept_sha256"], r["n_removed"], r["longest_run"]) for i, r in found.items()} == {
        i: (plain.sha(kept), n, run) for i, (kept, n, run) in expected.items()
    }
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns
    for row in kept.collect():
        was = dict(docs)[row["doc_id"]]
        assert row["text"] == (None if was is None else expected[row["doc_id"]][0])
        assert row["n_chars"] == len(row["text"] or "") and row["kept"] == "x" and row["tag"] == 2.0


def test_line_dedup_of_repeated_rows_nulls_and_nothing(spark):
    run = "\n".join(f"line {i}" for i in range(5))
    rows = [(None, run), (3, f"top\n{run}"), (3, f"top\n{run}"), (3, f"{run}\nend"), (4, None)]
    df = line_dedup.dedup_lines(plain.documents(spark, rows))
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert got == [("3", "end"), ("3", "top"), ("3", "top"), ("4", "None"), ("None", run)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_fingerprints_and_groups(spark):
    rng = random.Random(9)
    docs = [(i, _prose(rng, rng.randint(0, 300))) for i in range(40)]
    for i in range(40, 80):
        words = docs[rng.randrange(40)][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(90, None), (91, ""), (92, " \t"), (93, "One"), (94, "one"), (95, "a\tB\nc d")]
    df = plain.documents(spark, docs)
    rows = simhash.simhash_groups(df).collect()
    prints = {i: plain.simhash(t) for i, t in docs}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == prints
    expected = plain.groups(prints)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("bucket", [1, 8, 4096])
def test_links_within_two_bits_for_any_bucket_size(spark, bucket):
    rng = random.Random(4)
    values = set()
    for _ in range(30):
        seed = rng.getrandbits(64)
        for _ in range(40):
            value = seed
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
            if rng.random() < 0.2:
                seed = value
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    rows = components(simhash.links(prints, bucket)).collect()
    found: dict[int, set] = {}
    for row in rows:
        found.setdefault(row["root"], set()).add(row["node"] % 2**64)
    by_value = plain.groups({v: v for v in values})
    expected: dict[int, set] = {}
    for value, root in by_value.items():
        expected.setdefault(root, set()).add(value)
    assert sorted(map(sorted, found.values())) == sorted(
        sorted(group) for group in expected.values() if len(group) > 1
    )


def test_simhash_of_repeated_rows_nulls_and_nothing(spark):
    text = "one two three four five six"
    rows = [(None, text), (5, text), (5, text), (5, "else " * 9), (6, "else " * 9), (None, "alone a b")]
    df = plain.documents(spark, rows)
    found = simhash.simhash_groups(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == sorted(
        [("None", "5"), ("5", "5"), ("5", "5"), ("5", "5"), ("6", "5"), ("None", "None")]
    )
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(df).collect()]
    assert sorted(kept, key=str) == sorted([(5, text), (5, "else " * 9), (None, "alone a b")], key=str)
    assert simhash.simhash_groups(spark.createDataFrame([], EMPTY)).count() == 0
    assert simhash.keep_first(spark.createDataFrame([], EMPTY)).count() == 0


def test_components_of_long_chains_and_null_links(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 100), (None, 3), (100, 150), (200, 100)]
    random.Random(1).shuffle(chain)
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {
        **dict.fromkeys(range(61), 0), **dict.fromkeys([100, 150, 200], 100)
    }
    assert len(found) == 64


@pytest.mark.parametrize("doc_id", [None, 5])
def test_texts_whose_short_hashes_are_equal_keep_their_own_lines(spark, doc_id):
    """Two texts that share a doc_id, or have none, and one 32-bit hash are two documents."""
    rng = random.Random(8)
    passage = "\n".join(_prose(rng, 12, "abcdefgh") for _ in range(5))
    other = "\n".join(_prose(rng, 12, "ijklmnop") for _ in range(5))
    made = spark.range(300_000).select(
        F.concat(F.lit(passage + "\n"), "id").alias("a"), F.concat(F.lit(other + "\n"), "id").alias("b")
    )
    pairs = made.select("a", F.hash("a").alias("h")).join(made.select("b", F.hash("b").alias("h")), "h")
    repeated, clean = pairs.select("a", "b").first()
    docs = [(1, passage), (2, "another text")]
    rows = [*docs, (doc_id, repeated), (doc_id, clean)]
    if doc_id is None:
        # Without a doc_id they come first, and the passage of document 1 is the later copy.
        expected = {passage: True, repeated: False, clean: False}
    else:
        expected = {passage: False, repeated: True, clean: False}
    df = plain.documents(spark, rows)
    cut = suffix_dedup.remove_repeats(df).collect()
    removed = sorted((r["n_bytes"], r["n_removed"] > 0) for r in cut)
    assert removed == sorted((len(t.encode()), expected.get(t, False)) for _, t in rows)
    report = line_dedup.line_report(df).collect()
    lines = sorted((r["n_lines"], r["n_removed"] > 0) for r in report)
    assert lines == sorted((t.count("\n") + 1, expected.get(t, False)) for _, t in rows)


def test_rows_without_a_doc_id_do_not_meet_the_lowest_one(spark):
    keys = spark.createDataFrame([(None, "same"), (-(1 << 63), "same")], EMPTY).select(*line_dedup.document_key())
    rows = [tuple(r) for r in keys.collect()]
    assert rows[0] < rows[1] and rows[0][0] == rows[1][0]
