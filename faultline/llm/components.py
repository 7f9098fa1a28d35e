"""Connected components by alternating large and small stars, as plain joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.staging import stage


def components(links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (a, b) with the smallest node they reach: node, root.

    Each round points the larger neighbours of a node at its smallest one, then the smaller
    neighbours as well; the number of rounds grows with the logarithm of the longest path. Every
    round is a table of its own in the checkpoint folder. Rows with a null end or equal ends are
    ignored; repeated links count once; no links give no rows.
    """
    edges = stage(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = stage(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and a sum of their hashes."""
    mark = F.xxhash64("a", "b") % F.lit(1 << 40)
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), "m")
    return (
        moved.unionByName(least)
        .select(F.greatest("a", "m").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )
