"""Document fingerprints: votes, permuted block tables and the order of documents."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.llm import fingerprints as fp
from tests.llm import plain

PRINTS = "print binary, n long"


def slow_print(text):
    """The fingerprint of a short text, one term and one bit at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    pieces = []
    for word in text.encode().translate(fp._FOLD).split():
        pieces += [word[i : i + 12] for i in range(0, len(word), 12)]
    before, size, terms = 0, 0, {}
    for piece in pieces:
        code = mixed((sum((b + 1) * pow(fp._BASE, i, 1 << 64) for i, b in enumerate(piece)) + len(piece)) & mask)
        term = mixed((before * fp._BASE + code) & mask)
        weight, times = terms.get(term, (size + len(piece), 0))
        terms[term] = (weight, times + 1)
        before, size = code, len(piece)
    votes = np.zeros(128)
    for term, (weight, times) in terms.items():
        both = np.array([term, mixed((term + fp._BASE) & mask)], "<u8").view(np.uint8)
        votes += weight * times.bit_length() * (2.0 * np.unpackbits(both) - 1)
    return np.packbits(votes > 0).tobytes()


TEXTS = ["", "one", "a b a b a b", "Élan, vital! élan vital", "x" * 100 + " y", "ends. with\nlines\n\n", "  ", "日本語のテキスト"]


@pytest.mark.parametrize("at_a_time", [3, 1 << 15])
def test_votes_equal_those_of_single_terms(monkeypatch, at_a_time):
    monkeypatch.setattr(fp, "_TERMS_AT_A_TIME", at_a_time)
    got = fp.text_prints([t.encode() for t in TEXTS])
    assert [row.tobytes() for row in got] == [slow_print(t) for t in TEXTS]


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(1)
    words = [f"{rng.randrange(1 << 40):x}" for _ in range(3000)]
    words += ["".join(rng.choices("abcdefgh", k=size)) for size in (700, 5000)]  # without equal pieces
    rng.shuffle(words)
    texts = ["  ".join(words).encode(), b" " * 3000 + b"z " + b"".join(w.encode() for w in words[:200])]
    whole = fp.text_prints(texts)
    for size in (997, 4096):
        monkeypatch.setattr(fp, "_PART_BYTES", size)
        assert (fp.text_prints(texts) == whole).all()


def slow_near(rows, radius):
    bits = np.array([np.unpackbits(np.frombuffer(p, np.uint8)) for p, _ in rows])
    n = np.array([n for _, n in rows])
    apart = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    near = ((apart <= radius) & (apart > 0)) @ n
    return {p: int(k) for (p, _), k in zip(rows, near) if k}


@pytest.mark.parametrize(
    "radius, blocks, bucket", [(4, 5, 4096), (4, 6, 4096), (4, 5, 20), (3, 6, 5), (0, 1, 4096), (2, 8, 1)]
)
def test_tables_find_all_neighbours(spark, radius, blocks, bucket):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 256, (6, 16), np.uint8)
    made = set()
    for seed in seeds:
        for _ in range(40):
            bits = np.unpackbits(seed)
            bits[rng.choice(128, rng.integers(0, radius + 3), replace=False)] ^= 1
            made.add(np.packbits(bits).tobytes())
    made |= {row.tobytes() for row in rng.integers(0, 256, (100, 16), np.uint8)}
    rows = [(p, int(rng.integers(1, 5))) for p in sorted(made)]
    df = spark.createDataFrame([(bytearray(p), n) for p, n in rows], PRINTS).repartition(3)
    found = fp.near_counts(df, radius, blocks, bucket).collect()
    assert {bytes(r["print"]): r["near"] for r in found} == slow_near(rows, radius)


def _expected(rows):
    """Rows of distinct doc_ids: what the contract says of each."""
    order = sorted(rows, key=lambda r: -r[0])
    prints = {t or "": slow_print(t or "") for _, t in rows}
    out = {}
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]

        def like(a, b):
            return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / 128

        own, new = prints[text], slow_print(edited)
        out[doc_id] = (len(text), plain.sha(edited), own.hex(), new.hex(), like(own, new), like(own, prints[following]))
    near = {d: sum(e != d and round(128 * (1 - _like_hex(out[d][2], out[e][2]))) <= 4 for e in out) for d in out}
    return {d: (*row, near[d]) for d, row in out.items()}


def _like_hex(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


@pytest.mark.parametrize("parts", [1, 7])
def test_report_equals_the_contract(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3 - 50, " ".join(rng.choices(["naïve", "word", "日本", "x1", "end."], k=rng.randrange(30)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "solo"), (1003, rows[5][1]), (1004, "é" * 50)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = fp.fingerprint_report(plain.documents(spark, rows).repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == _expected(rows)


def test_single_rows_ties_and_nothing(spark):
    (only,) = fp.fingerprint_report(plain.documents(spark, [(7, "abc def ghi")])).collect()
    assert only["near_next"] == 1.0 and only["n_near"] == 0
    assert only["edited_sha256"] == plain.sha("abc def abc")
    rows = [(None, "same")] * 30 + [(3, "other")] * 5 + [(3, "third"), (None, None)]
    found = fp.fingerprint_report(plain.documents(spark, rows)).toPandas()
    assert len(found) == len(rows) and found.groupby("fingerprint").size().to_dict() == {
        slow_print("same").hex(): 30, slow_print("other").hex(): 5, slow_print("third").hex(): 1, slow_print("").hex(): 1
    }
    assert set(found[found.fingerprint == slow_print("same").hex()]["n_near"]) == {29}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprint_report(empty).count() == 0


def test_edits_stay_nearer_than_other_texts(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    found = fp.fingerprint_report(frame).toPandas()
    other = found[(found["near_next"] < 0.9) & (found["n_chars"] > 100)]
    assert (other["near_edited"] > other["near_next"]).mean() > 0.99
    marks = {r["doc_id"]: bytes(r["print"]).hex() for r in fp.fingerprints(frame).collect()}
    assert marks == dict(zip(found["doc_id"], found["fingerprint"]))


def test_no_pairs_are_written(spark):
    """A key of a thousand members gives a row per member, not one per pair."""
    rng = np.random.default_rng(9)
    bits = np.zeros((1000, 128), np.uint8)
    bits[:, 100:] = rng.integers(0, 2, (1000, 28))
    rows = {np.packbits(row).tobytes() for row in bits}
    df = spark.createDataFrame([(bytearray(p), 1) for p in rows], PRINTS)
    found = fp.near_counts(df, 4, 5, 100)
    assert found.select(F.sum("near")).first()[0] == sum(slow_near([(p, 1) for p in rows], 4).values())
