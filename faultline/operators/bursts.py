"""Burst clusters: matches of one rule in one file, packed close in time.

The clustering is greedy in line order. A cluster opens at a match (its anchor) and takes
every following match up to ``window_ms`` after the anchor; the match that breaks it opens
the next one. Where anchor and match both show 0 ms there is no clock, and a gap of more
than 50 lines to the match before breaks instead.

Done naively that is one sequential pass per (file, rule). Three facts split it up exactly:

* An anchor's time is always a new maximum among the matches so far (the breaking match lies
  beyond everything its cluster could hold), so only the strictly increasing record times
  matter, and each anchor is the first record beyond the previous anchor plus the window.
* Records are cut into spans of a fixed number, whatever the window. What a span does to the
  chain is a step function: from the time up to which the last cluster before it reaches, to
  the last anchor in the span. Each span's function is found on its own, and functions of
  neighbours are composed, ``FAN`` at a time, in a tree; only the chain's way into each node
  is then handed down, and every span lists its anchors on its own.
* Matches belong to the latest anchor at or above their line: a running maximum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.ordered import CHUNK_LINES, chunk_of, map_groups, with_row_number, with_running
from faultline.rules import RULE_LIBRARY, Rule
from faultline.staging import fits_broadcast, stage

MAX_LINE_GAP = 50  # fixed value: gap that breaks a cluster without a clock
SPAN_RECORDS = 1 << 16
FAN = 8  # functions that one task composes

_GROUP = ["file", "rule_ord"]
_ANCHOR = "file STRING, rule_ord INT, line_no BIGINT"
_ENTRY = "file STRING, rule_ord INT, node BIGINT, bound_ms BIGINT"
_FUNCTION = (
    "file STRING, rule_ord INT, node BIGINT, window_ms BIGINT, first_ms BIGINT, "
    "below_ms ARRAY<BIGINT>, last_ms ARRAY<BIGINT>"
)


def burst_settings(spark: SparkSession, rules: Sequence[Rule] = RULE_LIBRARY) -> DataFrame:
    """Burst rules only: rule_ord, burst_min, window_ms."""
    rows = [
        (i, rule.burst_min, int(rule.burst_window_s * 1000))
        for i, rule in enumerate(rules)
        if rule.is_burst
    ]
    return spark.createDataFrame(rows, "rule_ord INT, burst_min INT, window_ms BIGINT")


def burst_clusters(
    hits: DataFrame,
    settings: DataFrame,
    chunk_lines: int = CHUNK_LINES,
    span_records: int = SPAN_RECORDS,
) -> DataFrame:
    """Clusters that reach ``burst_min``: file, rule_ord, line_no (the anchor's), lines, size.

    ``hits`` needs file, rule_ord, line_no and elapsed_ms; rules without settings are left
    out. ``lines`` lists the members in order.
    """
    members = stage(burst_members(hits, settings, chunk_lines, span_records), "burst-members")
    cluster = [*_GROUP, "anchor_line"]
    # Sizes first, so that lists are gathered of reported clusters only.
    reported = stage(
        members.groupBy(*cluster, "burst_min")
        .agg(F.count(F.lit(1)).cast("int").alias("size"))
        .filter(F.col("size") >= F.col("burst_min"))
        .drop("burst_min"),
        "burst-sizes",
        measured=True,
    )
    side = F.broadcast(reported) if fits_broadcast(reported) else reported
    return (
        members.join(side, cluster)
        .groupBy(*cluster, "size")
        .agg(F.array_sort(F.collect_list("line_no")).alias("lines"))
        .select(*_GROUP, F.col("anchor_line").alias("line_no"), "lines", "size")
    )


def burst_members(
    hits: DataFrame,
    settings: DataFrame,
    chunk_lines: int = CHUNK_LINES,
    span_records: int = SPAN_RECORDS,
) -> DataFrame:
    """Every hit with the line of its cluster's anchor (clusters of any size)."""
    # The settings have one row per rule; the hits are few and read several times below.
    timed = stage(
        with_running(
            hits.select(*_GROUP, "line_no", F.col("elapsed_ms").alias("ms")).join(
                F.broadcast(settings), "rule_ord"
            ),
            _GROUP,
            "line_no",
            maxima_before={"top_ms": F.col("ms"), "line_before": F.col("line_no")},
            firsts={"first_ms": F.col("ms")},
            chunk_lines=chunk_lines,
        ),
        "burst-hits",
    )
    ms, window = F.col("ms"), F.col("window_ms")
    clockless_start = F.col("first_ms") == 0
    # Until a match lies beyond the window, a chain that starts at 0 ms stays anchored at 0.
    anchored_at_zero = clockless_start & (ms <= window) & (
        F.coalesce("top_ms", F.lit(0)) <= window
    )
    zero_anchors = timed.filter(
        anchored_at_zero
        & (
            F.col("line_before").isNull()
            | ((ms == 0) & (F.col("line_no") - F.col("line_before") > MAX_LINE_GAP))
        )
    ).select(*_GROUP, "line_no")
    records = timed.filter(
        (F.col("top_ms").isNull() | (ms > F.col("top_ms")))
        & (~clockless_start | (ms > window))
    ).select(*_GROUP, "line_no", "ms", "window_ms")

    anchors = stage(
        zero_anchors.unionByName(_chain_anchors(records, chunk_lines, span_records)).select(
            *_GROUP, "line_no", F.lit(True).alias("is_anchor")
        ),
        "anchors",
    )
    flagged = timed.select(*_GROUP, "line_no", "burst_min").join(
        anchors, [*_GROUP, "line_no"], "left"
    )
    return with_running(
        flagged,
        _GROUP,
        "line_no",
        maxima={"anchor_line": F.when(F.col("is_anchor"), F.col("line_no"))},
        chunk_lines=chunk_lines,
    ).drop("is_anchor")


def _chain_anchors(records: DataFrame, chunk_lines: int, span_records: int) -> DataFrame:
    """Anchors among the records: file, rule_ord, line_no."""
    # Records rise in line_no and ms alike.
    numbered = with_row_number(
        records,
        keys=_GROUP,
        coarse={"chunk": chunk_of("line_no", chunk_lines)},
        coarse_order=[F.col("_unit_chunk")],
        order=[F.col("line_no")],
        out="nth",
    )
    node = F.floor((F.col("nth") - 1) / F.lit(span_records)).cast("bigint")
    spans = stage(numbered.select(*_GROUP, "line_no", "ms", "window_ms", node.alias("node")), "spans")
    one_span = [*_GROUP, "node"]
    if spans.agg(F.max("node")).first()[0]:
        entered = spans.join(_entries(_function_levels(spans)), one_span)
    else:  # every group is one span
        entered = spans.withColumn("bound_ms", F.lit(None).cast("bigint"))
    return map_groups(entered, one_span, ["ms"], _walk_span, _ANCHOR)


def _function_levels(spans: DataFrame) -> list[DataFrame]:
    """The functions of all spans, then those of FAN neighbours each, up to one node per group."""
    levels = [
        stage(map_groups(spans, [*_GROUP, "node"], ["ms"], _summarise_span, _FUNCTION), "functions")
    ]
    while levels[-1].agg(F.max("node")).first()[0]:
        parents = levels[-1].withColumn("parent", _parent())
        composed = map_groups(parents, [*_GROUP, "parent"], ["node"], _compose, _FUNCTION)
        levels.append(stage(composed, "functions"))
    return levels


def _parent():
    return F.floor(F.col("node") / F.lit(FAN)).cast("bigint")


def _entries(levels: list[DataFrame]) -> DataFrame:
    """How far the last cluster before each span reaches, for the spans that hold an anchor."""
    entries = levels[-1].select(*_GROUP, "node", F.lit(None).cast("bigint").alias("bound_ms"))
    for level in reversed(levels[:-1]):
        above = entries.withColumnRenamed("node", "parent")
        children = level.withColumn("parent", _parent()).join(above, [*_GROUP, "parent"])
        entries = stage(
            map_groups(children, [*_GROUP, "parent"], ["node"], _enter_children, _ENTRY), "entries"
        )
    return entries


def _next_anchor(times: np.ndarray, window: int) -> np.ndarray:
    """For each record, the index of the anchor after it; ``len(times)`` if none is left."""
    return np.searchsorted(times, times + window, side="right")


def _summarise_span(span: pd.DataFrame) -> Iterator[tuple]:
    times, window = span["ms"].to_numpy(), int(span["window_ms"].iloc[0])
    following = _next_anchor(times, window)
    last = np.where(following < len(times), following, np.arange(len(times)))
    while True:  # each step doubles how far along the chain every record looks
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    below, final = _steps(times, times[last], int(times[0]), window)
    yield *span[[*_GROUP, "node"]].iloc[0], window, int(times[0]), below, final


def _steps(
    below: np.ndarray, last: np.ndarray, first: int, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """A step function in its shortest form: a cluster that reaches to a time under ``below[j]``,
    but not under ``below[j - 1]``, is followed by anchors up to ``last[j]``.

    The cluster before opened before ``first``, so it ends before first + window. One that
    reaches all of ``below`` is followed by none.
    """
    used = int(np.searchsorted(below, first + window - 1, side="right")) + 1
    below, last = below[:used], last[:used]
    ends = np.append(last[1:] != last[:-1], True)
    return below[ends], last[ends]


def _after(bound: np.ndarray, below: np.ndarray, last: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """The last anchor where clusters reach to ``bound``; ``passed`` where none follows."""
    at = np.searchsorted(below, bound, side="right")
    return np.where(at < len(below), last[np.minimum(at, len(last) - 1)], passed)


def _compose(children: pd.DataFrame) -> Iterator[tuple]:
    """The function of neighbouring nodes, one after the other."""
    window, first = int(children["window_ms"].iloc[0]), int(children["first_ms"].iloc[0])
    below, last = (np.asarray(children[c].iloc[0]) for c in ("below_ms", "last_ms"))
    for row in children.iloc[1:].itertuples(index=False):
        own_below, own_last = np.asarray(row.below_ms), np.asarray(row.last_ms)
        new = own_below > below[-1]
        last = np.concatenate([_after(last + window, own_below, own_last, last), own_last[new]])
        below = np.concatenate([below, own_below[new]])
        below, last = _steps(below, last, first, window)
    yield *children[[*_GROUP, "parent"]].iloc[0], window, first, below, last


def _enter_children(children: pd.DataFrame) -> Iterator[tuple]:
    """The children in which the chain has an anchor, and how far the cluster before reaches."""
    bound = children["bound_ms"].iloc[0]
    bound = None if pd.isna(bound) else int(bound)
    for row in children.itertuples(index=False):
        at = 0 if bound is None else int(np.searchsorted(row.below_ms, bound, side="right"))
        if at < len(row.below_ms):
            yield row.file, row.rule_ord, row.node, bound
            bound = int(row.last_ms[at]) + row.window_ms


def _walk_span(span: pd.DataFrame) -> Iterator[tuple]:
    """The anchors of a span, from the first record that the cluster before does not reach."""
    times, lines = span["ms"].to_numpy(), span["line_no"].to_numpy()
    file, rule_ord = span["file"].iloc[0], int(span["rule_ord"].iloc[0])
    following = _next_anchor(times, int(span["window_ms"].iloc[0]))
    bound = span["bound_ms"].iloc[0]
    at = 0 if pd.isna(bound) else int(np.searchsorted(times, bound, side="right"))
    while at < len(times):
        yield file, rule_ord, int(lines[at])
        at = int(following[at])
