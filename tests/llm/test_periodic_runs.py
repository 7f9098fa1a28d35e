"""Periodic runs of words against a brute-force search over all periods."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from faultline.llm import periodic_runs
from faultline.llm.periodic_runs import run_digests, with_planted_runs, word_runs
from tests.llm import plain


def slow_runs(words, min_words=6, min_periods=4):
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(min_words, min_periods * q):
                found.setdefault((start, at + q), q)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def planted(doc_id, text):
    words = re.findall(plain.SPACE, text or "")
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def report(words):
    runs = slow_runs(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    text = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *best, exponent, plain.sha(text), plain.sha(kept))


def some_words(rng):
    words = [rng.choice("abcdé") for _ in range(rng.randrange(40))]
    if rng.random() < 0.6 and words:
        unit = words[: rng.randrange(1, 6)]
        words = words + unit * rng.randrange(2, 9) + words[: rng.randrange(4)]
    return words


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic_runs, "_ASKED_AT_A_TIME", rng.choice([1, 7, 1 << 20]))
    monkeypatch.setattr(periodic_runs, "_JUMPS", rng.choice([0, 1, 8]))
    least, periods = rng.choice([(6, 4), (2, 2), (1, 3)])
    docs = [some_words(rng) for _ in range(rng.randrange(1, 8))]
    codes = {w: i for i, w in enumerate("abcdé")}
    ids = np.array([codes[w] for doc in docs for w in doc], np.int64)
    sizes = np.array([len(doc) for doc in docs])
    start, stop, period = word_runs(ids, sizes, least, periods)
    got = list(zip(start.tolist(), (stop - start).tolist(), period.tolist()))
    first = np.cumsum(sizes) - sizes
    expected = [
        (s + f, n, q) for doc, f in zip(docs, first.tolist()) for s, n, q in slow_runs(doc, least, periods)
    ]
    assert got == sorted(expected, key=lambda r: (r[0], r[2]))


def _reports(spark, rows):
    found = run_digests(periodic_runs.periodic_runs(with_planted_runs(plain.documents(spark, rows))))
    assert found.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ]
    return sorted(map(tuple, found.collect()), key=repr)


def test_query_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(periodic_runs, "_BATCH_BYTES", 300)
    gaps = [" ", "  ", "\n", "\t \x0b", "\r\n\x0c"]
    rows = [(i, "".join(w + rng.choice(gaps) for w in some_words(rng))) for i in range(-20, 300)]
    rows += [(400, " a" * 50), (401, "\n\n "), (402, ""), (403, None), (None, "b " * 9), (404, "x y z " * 30)]
    rows += [(405, "no\u00a0break\x1cspace " * 7)] * 3  # repeated rows; other white space is no gap
    expected = [(i, *report(planted(i, t))) for i, t in rows]
    assert _reports(spark, rows) == sorted(expected, key=repr)
    assert sum(crc32(str(i).encode()) % 10 == 0 for i, t in rows if t and i is not None) > 20


def test_long_and_wholly_periodic_texts(spark):
    rng = random.Random(4)
    long = [rng.choice("ab") for _ in range(3000)] + ["c", "d"] * 20_000 + ["e"] * 5
    rows = [(1, " ".join(long)), (2, "z " * 100_000)]
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(plain.documents(spark, rows)).collect()}
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 100_000, 1)] and found[2]["collapsed"] == "z"
    assert (3000, 40_000, 2) in [tuple(r) for r in found[1]["runs"]]
    assert found[1]["collapsed"].endswith("c d e e e e e")
    digest = hashlib.sha256(found[1]["collapsed"].encode()).hexdigest()
    assert digest == report(long[:3000] + ["c", "d"] * 4 + ["e"] * 5)[-1]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run_digests(periodic_runs.periodic_runs(with_planted_runs(empty))).count() == 0
