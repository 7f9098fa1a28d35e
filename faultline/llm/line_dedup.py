"""Line dedup by a suffix array over line sequences, built by distributed prefix doubling.

Lines with a word are numbered within their document; equal lines are one symbol. Round k ranks
every suffix by its first 2**k lines: the pair (rank here, rank 2**(k-1) lines further) is sorted
over all documents, and only pairs that occur more than once go on. What shares a rank in round k
is an interval of the suffix array whose longest common prefix is at least 2**k lines. Its first
member, by (doc_id, line), is kept and the others are later copies; the union of a document's
later copies over all rounds is the union of the maximal repeated runs that started earlier.

A run of lines is deleted from a later copy if it has ``MIN_LINES`` lines, or ``MIN_WORDS`` words
within one or two lines. Runs of MIN_LINES cover all longer ones, so deeper rounds delete nothing
more; they tell how long the runs are.

Defined cases: null and empty texts and texts of blank lines have no lines and come back as they
were (null stays null); blank lines are never deleted and do not interrupt a run. Documents come
in the order of (doc_id, hash of the text), nulls first. Equal rows are one document: both lose
what an earlier document has, neither counts as a copy of the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.staging import stage

MIN_LINES = 4
MIN_WORDS = 20
KEY = ["id", "tag", "low"]
_HAS_WORD = r"[^ \t\n\x0B\f\r]"


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns id, tag and low: doc_id with nulls first, and 127 bits of hash of the text.

    The hash tells apart texts that share a doc_id or have none. The sign of tag is set for a null
    doc_id, so that no row without one meets a row that has the lowest one.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    high = F.xxhash64(content).bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
    return [
        F.coalesce(F.col(doc_id).cast("long"), lowest).alias("id"),
        F.when(F.col(doc_id).isNull(), high.bitwiseOR(lowest)).otherwise(high).alias("tag"),
        F.xxhash64(F.lit(1), content).alias("low"),
    ]


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: id, tag, low, n (from 0), two hashes of the line and its number of words."""
    lines = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda s: s.rlike(_HAS_WORD))
    return (
        docs.select(*document_key(), lines.alias("lines"))
        .select(*KEY, F.posexplode("lines").alias("n", "line"))
        .select(
            *KEY,
            F.col("n").cast("long").alias("n"),
            F.xxhash64("line").alias("a"),
            F.hash("line").cast("long").alias("b"),
            F.size(F.filter(F.split("line", r"[ \t\x0B\f\r]+"), lambda w: w != ""))
            .cast("long")
            .alias("words"),
        )
        .distinct()
    )


def suffix_blocks(docs: DataFrame, rounds: int | None = None) -> list[DataFrame]:
    """For each round k the suffixes that share their first 2**k lines with another one.

    All rounds, or the first ``rounds``. Columns id, tag, low, n, words (of the 2**k lines), rank (in the order of the suffix array) and
    later (whether an earlier suffix has the same lines).
    """
    level = _ranked(stage(numbered_lines(docs), "lines"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        if len(levels) == rounds:
            break
        step = 1 << (len(levels) - 1)
        ahead = level.select(
            *KEY,
            (F.col("n") - step).alias("n"),
            F.col("words").alias("more"),
            F.col("rank").alias("b"),
        )
        pairs = level.select(*KEY, "n", "words", F.col("rank").alias("a")).join(
            ahead, [*KEY, "n"]
        )
        level = _ranked(
            stage(
                pairs.select(*KEY, "n", "a", "b", (F.col("words") + F.col("more")).alias("words")),
                "line-pairs",
            )
        )
    return levels


def _ranked(pairs: DataFrame) -> DataFrame:
    """Suffixes whose pair (a, b) is not unique, with the rank of the pair."""
    first = F.min(F.struct(*KEY, "n")).alias("first")
    shared = (
        pairs.groupBy("a", "b")
        .agg(first, F.count(F.lit(1)).alias("many"))
        .filter("many > 1")
        .drop("many")
        .repartitionByRange("a", "b")
        .sortWithinPartitions("a", "b")
        # Grows with the order of the rows over all partitions, which is all a rank has to do.
        .withColumn("rank", F.monotonically_increasing_id())
    )
    later = F.struct(*KEY, "n") != F.col("first")
    return stage(
        pairs.join(stage(shared, "line-ranks"), ["a", "b"]).select(
            *KEY, "n", "words", "rank", later.alias("later")
        ),
        "line-suffixes",
    )


def later_copies(levels: list[DataFrame]) -> DataFrame | None:
    """Numbers of the lines to delete: id, tag, low, removed (array)."""
    parts = []
    for k, level in enumerate(levels[: MIN_LINES.bit_length()]):
        long_enough = F.lit(1 << k >= MIN_LINES) | (F.col("words") >= MIN_WORDS)
        lines = F.explode(F.sequence(F.col("n"), F.col("n") + ((1 << k) - 1)))
        parts.append(level.filter(F.col("later") & long_enough).select(*KEY, lines.alias("n")))
    if not parts:
        return None
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*KEY).agg(F.collect_set("n").alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """Struct (kept, n_lines, n_removed) of a text less the numbered lines."""

    @F.pandas_udf("kept string, n_lines long, n_removed long")
    def cut(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = [_cut(t, set() if r is None else set(r)) for t, r in zip(texts, numbers)]
        return pd.DataFrame(rows, columns=["kept", "n_lines", "n_removed"])

    return cut(text, removed)


def _cut(text: str | None, removed: set[int]) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    kept, n = [], 0
    for line in text.split("\n"):
        filled = bool(line.strip(" \t\x0b\x0c\r"))
        if not (filled and n in removed):
            kept.append(line)
        n += filled
    return "\n".join(kept), n, len(removed)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of the text; n_chars follows it."""
    cut = _with_cut(docs, later_copies(suffix_blocks(docs, MIN_LINES.bit_length())))
    columns = [
        F.col("_cut.kept").alias(c)
        if c == "text"
        else F.coalesce(F.length("_cut.kept"), F.lit(0)).cast("long").alias(c)
        if c == "n_chars"
        else F.col(f"_docs.{_quoted(c)}").alias(c)
        for c in docs.columns
    ]
    return cut.select(*columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _with_cut(docs: DataFrame, removed: DataFrame | None) -> DataFrame:
    """Structs ``_docs`` (the row as it came) and ``_cut``, with id, tag and low."""
    rows = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("_docs"))
    text = F.col("_docs.text").cast("string")
    rows = rows.select("_docs", *document_key("_docs.doc_id", "_docs.text"))
    if removed is None:
        none = F.lit(None).cast("array<bigint>")
        return rows.withColumn("_cut", without_lines(text, none))
    joined = rows.join(removed, KEY, "left")
    return joined.withColumn("_cut", without_lines(text, F.col("removed"))).drop("removed")


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, longest_run, kept_sha256.

    ``longest_run`` is the largest power of two for which so many lines in a row also stand
    elsewhere, 0 if no line does.
    """
    levels = suffix_blocks(docs)
    cut = _with_cut(docs.select("doc_id", "text"), later_copies(levels))
    runs = None
    for k, level in enumerate(levels):
        part = level.select(*KEY, F.lit(1 << k).cast("long").alias("run"))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        cut = cut.withColumn("longest_run", F.lit(0).cast("long"))
    else:
        cut = cut.join(runs.groupBy(*KEY).agg(F.max("run").alias("longest_run")), KEY, "left")
    return cut.select(
        F.col("_docs.doc_id").alias("doc_id"),
        "_cut.n_lines",
        "_cut.n_removed",
        F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"),
        F.sha2(F.coalesce("_cut.kept", F.lit("")), 256).alias("kept_sha256"),
    )
