import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import bursts, ordered
from faultline.operators.bursts import burst_clusters
from faultline.operators.ordered import with_row_number, with_running
from tests.models import greedy_clusters

HITS = "file STRING, rule_ord INT, line_no BIGINT, elapsed_ms BIGINT"


def settings(spark, burst_min, window_ms, n_rules=1):
    rows = [(i, burst_min, window_ms) for i in range(n_rules)]
    return spark.createDataFrame(rows, "rule_ord INT, burst_min INT, window_ms BIGINT")


@pytest.mark.parametrize(
    ("hits", "kept"),
    [
        ([(1, 100), (2, 900), (3, 2100), (4, 2101), (5, 2200)], [[1, 2, 3]]),
        ([(1, 5000), (2, 100), (3, 5100)], [[1, 2, 3]]),
        ([(1, 0), (40, 0), (91, 0), (141, 0)], []),
        ([(1, 0), (2, 2001), (3, 2002), (4, 2003)], [[2, 3, 4]]),
    ],
)
def test_worked_examples(spark, hits, kept):
    df = spark.createDataFrame([("f", 0, *h) for h in hits], HITS)
    assert greedy_clusters(hits, 2000, 3) == kept
    got = burst_clusters(df, settings(spark, 3, 2000)).orderBy("line_no").collect()
    assert [r["lines"] for r in got] == kept
    assert [(r["line_no"], r["size"]) for r in got] == [(k[0], len(k)) for k in kept]


def random_hits(rng, style, n):
    line, ms, out = 0, 0, []
    for _ in range(n):
        line += rng.choice([1, 1, 2, 30, 60])
        if style == "steady":
            ms += 7
        elif style == "jitter":
            ms = max(0, ms + rng.choice([-3, 0, 1, 4, 9, 40]))
        elif style == "restarts":
            ms = 0 if rng.random() < 0.05 else ms + rng.randrange(30)
        elif style == "clockless":
            ms = rng.choice([0, 0, 0, 0, 0, 0, 30, 45, 60, 130])
        else:
            ms = rng.randrange(2000)
        out.append((line, ms))
    return out


@pytest.mark.parametrize(("chunk_lines", "span_records"), [(3, 1), (40, 2), (40, 7), (1 << 18, 1 << 16)])
def test_equals_the_sequential_pass(spark, chunk_lines, span_records):
    rng = random.Random(chunk_lines + span_records)
    rows, expected = [], []
    for i in range(60):
        style = ("steady", "jitter", "restarts", "clockless", "wild")[i % 5]
        for rule in (0, 1):
            hits = random_hits(rng, style, rng.randrange(1, 70))
            rows += [(f"f{i}", rule, *h) for h in hits]
            expected += [(f"f{i}", rule, k) for k in greedy_clusters(hits, 50, 2)]
    rng.shuffle(rows)
    got = burst_clusters(
        spark.createDataFrame(rows, HITS), settings(spark, 2, 50, 2), chunk_lines, span_records
    ).collect()
    assert sorted((r["file"], r["rule_ord"], r["lines"]) for r in got) == sorted(expected)


def _chain(times, window):
    anchors = times[:1]
    for ms in times:
        if ms > anchors[-1] + window:
            anchors.append(ms)
    return anchors


def _function(times, window, node=0):
    frame = pd.DataFrame({"file": "f", "rule_ord": 0, "node": node, "ms": times, "window_ms": window})
    (row,) = bursts._summarise_span(frame)
    return row


@pytest.mark.parametrize("seed", range(40))
def test_composed_functions_follow_the_chain(seed):
    """A tree of functions leads into each span where the sequential chain enters it."""
    rng = random.Random(seed)
    times = sorted(rng.sample(range(3000), rng.randrange(5, 400)))
    window, size = rng.choice([0, 1, 9, 60, 700, 5000]), rng.choice([1, 3, 10])
    columns = [c.split()[0] for c in bursts._FUNCTION.split(", ")]
    nodes = [_function(times[i : i + size], window, i // size) for i in range(0, len(times), size)]
    levels = [pd.DataFrame(nodes, columns=columns)]
    while len(levels[-1]) > 1:
        parents = levels[-1].assign(parent=levels[-1]["node"] // 3)
        composed = [row for _, group in parents.groupby("parent") for row in bursts._compose(group)]
        levels.append(pd.DataFrame(composed, columns=columns))
    assert levels[-1]["last_ms"].iloc[0][0] == _chain(times, window)[-1]
    bounds = {0: None}
    for level in reversed(levels[:-1]):
        below = {}
        for parent, group in level.groupby(level["node"] // 3):
            if parent in bounds:
                found = bursts._enter_children(group.assign(bound_ms=bounds[parent]))
                below |= {node: bound for _, _, node, bound in found}
        bounds = below
    got = []
    for node, bound in bounds.items():
        part = times[node * size : (node + 1) * size]
        frame = pd.DataFrame(
            {"file": "f", "rule_ord": 0, "ms": part, "line_no": part, "window_ms": window, "bound_ms": bound}
        )
        got += [line for _, _, line in bursts._walk_span(frame)]
    assert sorted(got) == _chain(times, window)


def test_functions_stay_short_where_the_window_is_long():
    """An hour's window over a day at one record a second: a step is kept per different ending."""
    times = list(range(0, 86_400_000, 1000))
    window = 3_600_000
    rows = [_function(times[i : i + 4096], window, i // 4096) for i in range(0, len(times), 4096)]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in bursts._FUNCTION.split(", ")])
    (whole,) = bursts._compose(frame.assign(parent=0))
    assert max(len(row[5]) for row in [*rows, whole]) <= 3601
    assert whole[6][0] == _chain(times, window)[-1]


def test_no_task_holds_more_than_a_span(spark, monkeypatch):
    """One file, a window longer than it: frames are bounded by records, not by the clock."""
    consecutive = ordered._consecutive

    def counted(batches, keys):
        for group in consecutive(batches, keys):
            if len(group) > 100:
                raise AssertionError(f"{len(group)} rows in one task")
            yield group

    monkeypatch.setattr(ordered, "_consecutive", counted)
    hits = [(i, 10 * i) for i in range(1, 1500)]
    df = spark.createDataFrame([("f", 0, *h) for h in hits], HITS)
    for window in (5000, 3_600_000):
        got = burst_clusters(df, settings(spark, 2, window), 1 << 18, 100).collect()
        assert sorted(r["lines"] for r in got) == greedy_clusters(hits, window, 2)


def test_running_values_do_not_depend_on_chunks(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(100)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, v BIGINT")
    expected = []
    for k in "ab":
        values = [v for key, _, v in rows if key == k]
        for i in range(200):
            before = max(values[:i]) if i else None
            expected.append((k, i, values[i], max(values[: i + 1]), before, values[0]))
    for chunk_lines in (1, 7, 64, 1000):
        got = with_running(
            df, ["k"], "i",
            maxima={"top": F.col("v")},
            maxima_before={"top_before": F.col("v")},
            firsts={"first": F.col("v")},
            chunk_lines=chunk_lines,
        )
        assert sorted(map(tuple, got.collect())) == expected


def test_row_numbers_without_a_key(spark):
    rows = list(range(0, 3000, 7))
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "i BIGINT")
    got = with_row_number(
        df, [], {"chunk": F.floor(F.col("i") / 100)}, [F.col("_unit_chunk")], [F.col("i")], "n"
    ).collect()
    assert sorted(map(tuple, got)) == [(v, n) for n, v in enumerate(sorted(rows), 1)]
