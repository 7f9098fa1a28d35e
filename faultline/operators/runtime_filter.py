"""A filter made at run time, which keeps rows that cannot join from being shuffled.

The keys of the small side set bits of a table of bits, by hash; a row of the large side whose bit
is not set has no partner. Spark's own aggregate gathers the bits, 32,768 to a row, so the table is
built by partial aggregation. It has at least ``BITS_PER_KEY`` bits for each key, up to ``MOST_BITS``
(32 MB), which bounds what is broadcast whatever the number of keys. Rows that pass by chance are
dropped by the join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.staging import stage

ROW_BITS = 32_768  # fixed by bitmap_construct_agg
BITS_PER_KEY = 16
MOST_BITS = 1 << 28


def likely_members(
    rows: DataFrame, keys: DataFrame, on: list[str], most_bits: int = MOST_BITS
) -> DataFrame:
    """The rows whose ``on`` may stand among the keys: all that do, and few others."""
    bits = ROW_BITS
    wanted = keys.count() * BITS_PER_KEY
    while bits < min(wanted, most_bits):
        bits *= 2
    table = stage(
        keys.select(_place(on, bits).alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")),
        "key-bits",
    )
    place = F.col("_place")
    return (
        rows.withColumn("_place", _place(on, bits))
        .withColumn("_bucket", F.bitmap_bucket_number("_place"))
        .join(F.broadcast(table), "_bucket")  # at most most_bits
        .filter(_is_set(F.col("_bits"), F.bitmap_bit_position(place)))
        .select(*rows.columns)
    )


def _place(on: list[str], bits: int) -> Column:
    """A bit from 1 on, as bit positions and buckets of positive numbers are counted."""
    return F.pmod(F.xxhash64(*on), F.lit(bits)) + 1


def _is_set(bits: Column, position: Column) -> Column:
    """Bits are laid out from the lowest of the first byte."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.call_function("bit_get", byte.cast("int"), (position % 8).cast("int")) == 1
