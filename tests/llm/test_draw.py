"""The candidates that the span classifier learns from."""

import numpy as np

from faultline.llm import pii
from tests.llm import plain

TEXTS = [f"login password=k{n}Zq{n * 7919}x now" for n in range(6)]


def test_copies_do_not_empty_the_draw(spark):
    few = plain.documents(spark, list(enumerate(TEXTS)))
    copied = plain.documents(spark, list(enumerate(TEXTS * 400)))
    # With a bound below the rows, as a share of which the six marks would all be left out.
    weights = pii.train(copied, sample=6)
    assert weights is not None
    assert all(len(pii.find_spans(text, weights)) == 1 for text in TEXTS)
    assert np.allclose(weights, pii.train(copied, sample=10**6))
    assert len(pii.train(few, sample=6)) == len(weights)


def test_drawn_are_the_smallest_marks_with_their_copies(spark):
    rows = [(kind, "0", mark, [at]) for mark in range(50) for kind in "ab" for at in range(3)]
    df = spark.createDataFrame(rows * 2, pii._CANDIDATES)
    for sample in (1, 7, 299, 300, 1000):
        drawn = [(r["mark"], r["kind"], r["features"][0], r["many"]) for r in pii._drawn(df, sample, 100)]
        assert drawn == sorted((mark, kind, own[0], 2) for kind, _, mark, own in rows)[:sample]
