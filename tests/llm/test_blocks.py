"""Blocks of a benchmark whose rows share one name."""

import random

import pytest

from faultline.llm import decontaminate
from tests.llm import plain
from tests.llm.test_texts import _sentence

BOUND = 2000


def _bytes(block):
    return sum(len(row["_utf8"]) + 64 for row in block.collect())


@pytest.mark.parametrize("name", [None, "one"])
def test_rows_of_one_name_are_dealt_over_blocks(spark, name):
    rng = random.Random(8)
    texts = [_sentence(rng, 30) for _ in range(40)]
    rows = [(name, text) for text in texts] * 2 + [(str(i), _sentence(rng, 20)) for i in range(20)]
    items = spark.createDataFrame(rows, "item_id string, text string")
    blocks = decontaminate._item_blocks(items, BOUND)
    assert len(blocks) > 2 and max(map(_bytes, blocks)) <= BOUND
    dealt = [(row["name"], bytes(row["_utf8"]).decode()) for block in blocks for row in block.collect()]
    assert sorted(dealt) == sorted({(own or "", text) for own, text in rows})

    docs = plain.documents(spark, [(0, f"a {texts[3]} b {texts[4]}"), (1, texts[39]), (2, "none of it")])
    found = {}
    for bound in (1 << 20, BOUND * 3):
        marked = decontaminate.with_contamination(docs, items, "hit", bound)
        found[bound] = {r["doc_id"]: r["hit"].asDict() for r in marked.collect()}
    first, second = found.values()
    assert first == second
    assert [first[i]["items"] for i in range(3)] == [[name or ""], [name or ""], []]


def test_one_row_beyond_the_bound_is_a_block(spark):
    rows = [("a", "x " * 5000), ("a", "y z"), (None, None)]
    items = spark.createDataFrame(rows, "item_id string, text string")
    sizes = sorted(_bytes(block) for block in decontaminate._item_blocks(items, BOUND))
    assert sizes[-1] == 10_064 and sum(sizes[:-1]) == 64 + 64 + 3
