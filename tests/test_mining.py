import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import mining
from faultline.operators.matching import match_texts, resolve_texts, tag_entries
from faultline.operators.mining import (
    count_lines,
    distinct_masked,
    mine_counted,
    mine_templates,
    number_templates,
)
from tests.models import Dictionary

WORKED = [
    "link up eth0", "link down eth0", "link x y", "scan a b c", "scan p q r", "scan a z z",
]


def texts_of(spark, messages):
    rows = [(i, m, True) for i, m in enumerate(messages)]
    return distinct_masked(
        spark.createDataFrame(rows, "pos BIGINT, message STRING, normal BOOLEAN")
    )


def templates_of(spark, messages, threshold, cap, round_size=20_000):
    mined = mine_templates(texts_of(spark, messages), threshold, cap, round_size)
    return number_templates(mined)


@pytest.mark.parametrize(
    ("cap", "expected"),
    [
        (128, ["link <*> <*>", "scan a <*> <*>", "scan p q r"]),
        (1, ["link <*> <*>", "scan a b c", "<*> <*> <*> <*>"]),
    ],
)
def test_worked_examples(spark, cap, expected):
    got = templates_of(spark, WORKED, 0.5, cap).orderBy("ord").collect()
    assert [(r["event_id"], r["template"]) for r in got] == [
        (f"E{i:04d}", t) for i, t in enumerate(expected)
    ]


def test_empty_message_has_its_own_template(spark):
    got = templates_of(spark, ["", "a", "  ", "b"], 0.5, 4).orderBy("ord").collect()
    assert [(r["n"], r["prefix"], r["tokens"], r["template"]) for r in got] == [
        (0, "<empty>", [], ""), (1, "a", ["a"], "a"), (1, "b", ["b"], "b"),
    ]


def random_messages(rng, n):
    words = ["up", "down", "eth", "wlan", "scan", "7", "0x1F", "fail"]
    return [
        " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 4, 4, 6, 6])))
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    ("threshold", "cap", "round_size"), [(0.5, 128, 20_000), (0.5, 3, 2), (0.8, 6, 5), (1.0, 2, 1)]
)
def test_equals_one_message_at_a_time(spark, threshold, cap, round_size):
    rng = random.Random(round_size)
    messages = random_messages(rng, 250 if round_size > 2 else 120)
    plain = Dictionary(threshold, cap)
    for message in messages:
        plain.add(" ".join("<*>" if w in ("7", "0x1F") else w for w in message.split()))
    templates = templates_of(spark, messages, threshold, cap, round_size)
    got = templates.orderBy("ord").collect()
    assert [r["template"] for r in got] == [" ".join(t.words) for t in plain.templates]
    assert [r["prefix"] for r in got] == [t.first for t in plain.templates]
    assert [r["event_id"] for r in got] == [f"E{i:04d}" for i in range(len(got))]

    unseen = random_messages(rng, 150)
    matched = match_texts(texts_of(spark, messages + unseen), templates, threshold)
    for row in matched.collect():
        at = plain.match(row["masked"])
        assert row["event_id"] == (None if at is None else f"E{at:04d}")
        assert row["template"] == (None if at is None else " ".join(plain.templates[at].words))


def test_every_trained_line_is_counted_once(spark):
    messages = random_messages(random.Random(9), 300)
    texts = texts_of(spark, messages)
    templates = number_templates(mine_templates(texts, 0.5, 4))
    matched = match_texts(texts, templates, 0.5)
    assert matched.filter(F.col("event_id").isNull()).count() == 0
    counted = count_lines(templates, matched)
    assert counted.agg(F.sum("n_lines")).first()[0] == 300


def test_rejects_a_threshold_no_merge_can_reach(spark):
    with pytest.raises(ValueError):
        mine_templates(texts_of(spark, ["a"]), 1.5)


def force_shuffle(monkeypatch):
    monkeypatch.setattr("faultline.operators.matching.fits_broadcast", lambda df: False)


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    messages = random_messages(random.Random(4), 200)
    texts = texts_of(spark, messages)
    templates = number_templates(mine_templates(texts, 0.5, 8)).cache()
    entries = spark.createDataFrame(
        [("f", i, m) for i, m in enumerate(messages)], "file STRING, line_no BIGINT, message STRING"
    )

    def tagged():
        resolved = resolve_texts(match_texts(texts, templates, 0.5), None)
        return sorted(map(str, tag_entries(entries, resolved).collect()))

    broadcast = tagged()
    force_shuffle(monkeypatch)
    assert tagged() == broadcast
    assert len(broadcast) == 200


def test_rounds_with_shuffle_joins(spark, monkeypatch):
    messages = random_messages(random.Random(6), 150)
    expected = sorted(map(str, templates_of(spark, messages, 0.6, 5).collect()))
    force_shuffle(monkeypatch)
    assert sorted(map(str, templates_of(spark, messages, 0.6, 5, 4).collect())) == expected


def test_tagging(spark):
    templates = spark.createDataFrame(
        [("E0000", 3, "link", ["link", "<*>", "up"], "link <*> up", 0)],
        "event_id STRING, n INT, prefix STRING, tokens ARRAY<STRING>, template STRING, ord BIGINT",
    )
    messages = ["link 7 up", "links are up", "nothing like it at all"]
    texts = texts_of(spark, messages)
    near = spark.createDataFrame(
        [("links are up", "E0000", 0.75, "link <*> up")],
        "masked STRING, event_id STRING, similarity DOUBLE, template STRING",
    )
    entries = spark.createDataFrame(
        [("f", i, m) for i, m in enumerate(messages)], "file STRING, line_no BIGINT, message STRING"
    )

    def tags(neighbours):
        resolved = resolve_texts(match_texts(texts, templates), neighbours)
        rows = tag_entries(entries, resolved).orderBy("line_no").collect()
        return [tuple(r)[3:] for r in rows]

    assert tags(near) == [
        ("E0000", "link <*> up", ["7"], None, None),
        ("E0000", "link <*> up", [], True, 0.75),
        ("<unk>", "nothing like it at all", [], False, None),
    ]
    assert tags(None)[1] == ("<unk>", "links are up", [], False, None)


def test_a_text_without_an_answer_is_unknown(spark):
    entries = spark.createDataFrame([("f", 1, "a 7")], "file STRING, line_no BIGINT, message STRING")
    none = resolve_texts(match_texts(texts_of(spark, ["b"]), templates_of(spark, ["b"], 0.5, 4)), None)
    row = tag_entries(entries, none).first()
    assert (row["event_id"], row["template"], row["params"]) == ("<unk>", "a <*>", ["7"])


def test_rounds_of_a_hot_bucket_are_bounded_without_a_window(spark):
    rows = [(i * i, 2, "x", f"x {i}") for i in range(3000)] + [(7, 1, "y", "y")]
    texts = spark.createDataFrame(rows, "pos BIGINT, n INT, prefix STRING, masked STRING")
    head = mining._first(texts, 100)
    assert "Window" not in head._jdf.queryExecution().toString()
    taken = {r["prefix"]: r for r in head.groupBy("prefix").agg(F.count("pos").alias("k"), F.max("pos").alias("last"), F.first("cut").alias("cut")).collect()}
    assert 1 <= taken["x"]["k"] <= 200 and taken["x"]["cut"]
    assert taken["x"]["last"] == (taken["x"]["k"] - 1) ** 2
    assert taken["y"]["k"] == 1 and not taken["y"]["cut"]


def counts_of(mined):
    rows = mined.select("n", "prefix", "pos", "template", "n_lines", "normal").collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize(
    ("threshold", "cap", "round_size", "held"),
    [(0.5, 128, 20_000, 1 << 22), (0.5, 3, 20_000, 1 << 22), (0.5, 2, 4, 1 << 22), (0.8, 6, 20_000, 9)],
)
def test_lines_are_counted_where_they_are_mined(spark, monkeypatch, threshold, cap, round_size, held):
    monkeypatch.setattr(mining, "HELD_TOKENS", held)
    rng = random.Random(cap)
    rows = [
        (i, m, rng.choice([True, False, None]))
        for i, m in enumerate(random_messages(rng, 200) + ["", "<*> up", "lone word", "7 7 7 7"])
    ]
    texts = distinct_masked(
        spark.createDataFrame(rows, "pos BIGINT, message STRING, normal BOOLEAN")
    ).cache()
    plain = number_templates(mine_templates(texts, threshold, cap, round_size)).cache()
    matched = match_texts(texts, plain, threshold)
    marks = matched.groupBy("event_id").agg(F.coalesce(F.bool_or("normal"), F.lit(False)).alias("normal"))
    want = count_lines(plain, matched).join(marks, "event_id", "left")
    got = number_templates(mine_counted(texts, threshold, cap, round_size))
    columns = ["event_id", "n", "prefix", "tokens", "template", "ord", "n_lines"]
    normal = F.coalesce("normal", F.lit(False)).alias("normal")
    assert sorted(map(str, got.select(*columns, normal).collect())) == sorted(
        map(str, want.select(*columns, normal).collect())
    )


def test_texts_of_whole_buckets_do_not_travel_again(spark, monkeypatch):
    def no_join(*args):
        raise AssertionError("texts are looked up in another task")

    monkeypatch.setattr(mining, "match_texts", no_join)
    texts = texts_of(spark, ["link up", "link down", "link up", "scan a b", "scan"]).cache()
    assert counts_of(mine_counted(texts)) == [
        (1, "scan", 4, "scan", 1, True),
        (2, "link", 0, "link <*>", 3, True),
        (3, "scan", 3, "scan a b", 1, True),
    ]


def test_lines_of_equal_positions_are_told_apart(spark):
    rows = [(0, m, True) for m in ("a b c d", "a x y z", "a p q r")] + [(1, "a b c e", False)]
    texts = distinct_masked(
        spark.createDataFrame(rows, "pos BIGINT, message STRING, normal BOOLEAN")
    ).cache()
    numbered = number_templates(mine_counted(texts, 0.5, 8)).orderBy("ord").collect()
    assert [r["ord"] for r in numbered] == [0, 1, 2]
    assert sorted(r["n_lines"] for r in numbered) == [1, 1, 2]


def test_a_text_is_split_and_looked_up_once(spark):
    texts = texts_of(spark, ["link up", "link down", "scan a b"]).cache()
    templates = number_templates(mine_templates(texts)).cache()
    matched = match_texts(texts, templates)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    per_template = plan(matched).split("transform(")[1].split("lambdafunction")[1]
    assert "split(" not in per_template
    counted = count_lines(templates, matched)
    assert "transform(" not in plan(counted).split("InMemoryRelation")[0]
    assert [r["n_lines"] for r in counted.orderBy("ord").collect()] == [2, 1]
