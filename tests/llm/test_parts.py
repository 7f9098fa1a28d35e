"""Suffix dedup decides a sorted partition a part at a time."""

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import suffix_dedup
from tests.llm import plain
from tests.llm.test_duplicates import _documents, _removed


def _batches(anchors, size):
    table = pa.table({"anchor": pa.array(anchors, pa.int64()), "at": pa.array(range(len(anchors)))})
    return table.to_batches(max_chunksize=size)


@pytest.mark.parametrize("most, size", [(50, 10), (50, 49), (7, 200), (1, 1)])
def test_parts_hold_whole_anchors_and_few_rows(most, size):
    rng = np.random.default_rng(1)
    anchors = np.repeat(np.arange(300), rng.integers(1, 6, 300))
    parts = list(suffix_dedup._whole_anchors(iter(_batches(anchors, size)), most))
    assert len(parts) > 1 and max(map(len, parts)) < most + size + 2 * 6
    assert [a for part in parts for a in part["anchor"].to_pylist()] == anchors.tolist()
    seen = [set(part["anchor"].to_pylist()) for part in parts]
    assert sum(map(len, seen)) == 300


def test_an_anchor_beyond_the_bound_is_joined_few_times(monkeypatch):
    joined = []
    table_of = pa.Table.from_batches

    class Counted:
        @staticmethod
        def from_batches(batches):
            joined.append(sum(map(len, batches)))
            return table_of(batches)

    monkeypatch.setattr(suffix_dedup.pa, "Table", Counted)
    parts = list(suffix_dedup._whole_anchors(iter(_batches([5] * 4000 + [6], 10)), 20))
    assert [len(part) for part in parts] in ([4000, 1], [4001])
    assert sum(joined) < 4 * 4001


def test_small_parts_remove_the_same(spark, monkeypatch):
    decide = suffix_dedup._decide
    docs = _documents(4)
    df = plain.documents(spark, docs).repartition(4)
    monkeypatch.setattr(suffix_dedup, "_decide", lambda batches: decide(_split(batches), 20))
    assert _removed(suffix_dedup.remove_repeats(df)) == plain.removed_strings(docs)


def _split(batches):
    for batch in batches:
        yield from (batch.slice(at, 9) for at in range(0, len(batch), 9))
