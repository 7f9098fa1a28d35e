"""Running maxima, first values and row numbers that hold up on one hot key.

A plain ``Window.partitionBy(file)`` puts a whole file into one task. Here each key is cut
into chunks that keep the order; the window runs inside a chunk, and what earlier chunks
contribute comes from a table with one narrow row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.staging import stage

# Lines per chunk: bounds the rows any one window or grouped task sees for a key.
CHUNK_LINES = 1 << 18

_FLUSH_ROWS = 10_000


def chunk_of(order: str, chunk_lines: int = CHUNK_LINES) -> Column:
    """Chunk number of an increasing, non-negative position column."""
    return F.floor(F.col(order) / F.lit(chunk_lines)).cast("bigint")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: str,
    maxima: dict[str, Column] | None = None,
    maxima_before: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Add running aggregates of each key in ``order``, which is unique within the key.

    ``maxima`` include the current row, ``maxima_before`` only the rows before it (null on
    the first), ``firsts`` give the value of the key's first row. Input columns stay.
    """
    maxima, maxima_before, firsts = maxima or {}, maxima_before or {}, firsts or {}
    tops = {**maxima, **maxima_before}
    chunked = df.withColumn("_chunk", chunk_of(order, chunk_lines))

    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.select(
        "*",
        *[F.max(c).over(upto).alias(f"_local_{name}") for name, c in maxima.items()],
        *[F.max(c).over(before).alias(f"_local_{name}") for name, c in maxima_before.items()],
        *[F.first(c).over(upto).alias(f"_local_{name}") for name, c in firsts.items()],
    )

    per_chunk = chunked.groupBy(*keys, "_chunk").agg(
        *[F.max(c).alias(name) for name, c in tops.items()],
        *[F.min_by(c, F.col(order)).alias(name) for name, c in firsts.items()],
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_chunk.select(
        *keys,
        "_chunk",
        *[F.max(name).over(earlier).alias(f"_carry_{name}") for name in tops],
        *[F.first(name).over(earlier).alias(f"_carry_{name}") for name in firsts],
    )
    return local.join(carry, [*keys, "_chunk"]).select(
        *[F.col(c) for c in df.columns],
        *[F.greatest(f"_carry_{name}", f"_local_{name}").alias(name) for name in tops],
        *[F.coalesce(f"_carry_{name}", f"_local_{name}").alias(name) for name in firsts],
    )


def with_row_number(
    df: DataFrame,
    keys: list[str],
    coarse: dict[str, Column],
    coarse_order: list[Column],
    order: list[Column],
    out: str,
) -> DataFrame:
    """Number the rows of each key from 1 in the order ``coarse_order`` then ``order``.

    ``coarse`` names the leading sort terms; rows that agree on them form the unit one task
    sorts, and the counts of the units before it are added on top.
    """
    units = [f"_unit_{name}" for name in coarse]
    marked = df.select("*", *[c.alias(f"_unit_{name}") for name, c in coarse.items()])
    local = marked.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys, *units).orderBy(*order))
    )
    sizes = marked.groupBy(*keys, *units).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*coarse_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys, *units, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    return local.join(offsets, [*keys, *units]).select(
        *[F.col(c) for c in df.columns],
        (F.col("_offset") + F.col(out)).cast("bigint").alias(out),
    )


def with_rank(df: DataFrame, order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """Number all rows from 1 in ``order``, whatever the values share.

    Rows are dealt to ranges that a sample of them bounds, so no prefix or key of theirs decides
    how many meet in a task. Each range is numbered where it lies; how many rows the ranges before
    it have comes from a table with one row per range. ``order`` has to be total for numbers to be
    repeatable; rows that agree on all of it share a range.
    """
    placed = _in_ranges(df, order, parts)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), "_range").select(  # one row per range
        *df.columns, (F.col("_offset") + F.col("_place") + 1).cast("bigint").alias(out)
    )


def _in_ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range and their place in it, as a written table."""
    dealt = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    return stage(
        dealt.sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("_range"), in_range.alias("_place")
        ),
        "ranges",
    )


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows_of: Callable[[pd.DataFrame], Iterable[tuple]],
    schema: str,
) -> DataFrame:
    """Apply ``rows_of`` to each group of ``keys``, sorted by ``order``.

    Like a grouped map, but the groups of a task stream through one Arrow exchange, so many
    small groups cost little. Only one group is held at a time; callers bound its size.
    """
    columns = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        for group in _consecutive(batches, keys):
            done.extend(rows_of(group))
            if len(done) >= _FLUSH_ROWS:
                yield pd.DataFrame(done, columns=columns)
                done = []
        yield pd.DataFrame(done, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _consecutive(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, joined across batches."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for batch in batches:
        ids = batch[keys]
        starts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            key = tuple(ids.iloc[start])
            if held and key != held_key:
                yield pd.concat(held)
                held = []
            held.append(batch.iloc[start:end])
            held_key = key
    if held:
        yield pd.concat(held)
