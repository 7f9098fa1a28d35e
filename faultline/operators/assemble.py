"""Multi-line entries from numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.lines import is_continuation, is_ps_line, ps_fields, strip
from faultline.operators.ordered import CHUNK_LINES, chunk_of
from faultline.staging import fits_broadcast, stage


def assemble_entries(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """One row per PS line, its message extended by the indented lines that follow.

    An indented line joins the latest PS line above it; other lines in between are skipped
    and do not end the entry; lines above the first PS line are dropped. Columns besides
    ``line_no`` and ``value`` that belong to the file (file, file_ord) stay.

    A narrow first pass finds each chunk's first and last PS line. An indented line above the first
    one of its chunk belongs to the last PS line of some earlier chunk, so the map step sends it
    to that chunk. Then lines are shuffled, sorted and aggregated once.
    """
    keys = [c for c in lines.columns if c not in ("line_no", "value")]
    value, is_ps = F.col("value"), F.col("is_ps")
    # The cheap first-character test drops most other lines; what it lets through besides PS
    # and indented lines has no tail below and adds nothing, so the pattern runs only once.
    kept = (
        lines.filter(value.startswith("[") | is_continuation(value))
        .withColumn("is_ps", is_ps_line(value))
        .withColumn("chunk", chunk_of("line_no", chunk_lines))
    )
    chunks = stage(_chunk_anchors(kept), "chunk-anchors", measured=True)
    side = F.broadcast(chunks) if fits_broadcast(chunks) else chunks
    # Null where no PS line comes before.
    target = F.when(F.col("line_no") < F.col("first_ps"), F.col("carried")).otherwise(F.col("chunk"))
    routed = (
        kept.join(side, ["file", "chunk"])
        .withColumn("chunk", target)
        .filter("chunk IS NOT NULL")
    )
    so_far = (
        Window.partitionBy("file", "chunk")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    anchored = routed.select(
        *keys, "line_no", "value", "is_ps", "chunk",
        F.last(F.when(is_ps, F.col("line_no")), ignorenulls=True).over(so_far).alias("anchor"),
    )
    # A struct starts with its line number, so sorting the list restores the line order.
    tail = F.when(is_continuation(value), F.struct("line_no", strip(value).alias("text")))
    pieces = anchored.groupBy(*keys, "chunk", "anchor").agg(
        F.max(F.when(is_ps, value)).alias("head"),
        F.array_sort(F.collect_list(tail)).alias("tail"),
    )
    return _finish(pieces, keys)


def _chunk_anchors(kept: DataFrame) -> DataFrame:
    """For each chunk its first PS line and the last chunk before it that has one.

    A chunk without a PS line has a first one past all its lines. One row per chunk.
    """
    ps_line = F.when(F.col("is_ps"), F.col("line_no"))
    chunks = kept.groupBy("file", "chunk").agg(F.min(ps_line).alias("first_ps"))
    above = (
        Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.when(F.col("first_ps").isNotNull(), F.col("chunk"))
    return chunks.select(
        "file",
        "chunk",
        F.coalesce("first_ps", F.lit((1 << 63) - 1)).alias("first_ps"),
        F.last(own, ignorenulls=True).over(above).alias("carried"),
    )


def _finish(pieces: DataFrame, keys: list[str]) -> DataFrame:
    fields = ps_fields(F.col("head"))
    texts = F.transform("tail", lambda part: part["text"])
    message = F.when(F.size("tail") == 0, fields["message"]).otherwise(
        F.concat_ws("\n", F.concat(F.array(fields["message"]), texts))
    )
    return pieces.select(
        *keys,
        F.col("anchor").alias("line_no"),
        fields["elapsed_ms"].alias("elapsed_ms"),
        fields["component"].alias("component"),
        fields["level"].alias("level"),
        message.alias("message"),
    )
