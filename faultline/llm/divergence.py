"""Source divergence audit over run-length encoded columns of counts.

Each language keeps the terms that stand in at least ``MIN_DOCUMENTS`` of its documents. The counts
of these terms in one source are a column; the column's smoothed shares are
p = 1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers. Two columns
diverge by the sum of abs(p - q) over all kept terms.

The vocabulary of a language is reordered so that equal counts cluster: terms with the same counts
in all sources become one entry with a multiplicity, and entries are range-partitioned and sorted by
their counts. A task streams its part of the order, encodes each column as runs of equal shares, and
for each pair of sources intersects the boundaries of their runs and multiplies the difference by
the length of the common run. Only these partial sums, one row per source and block of entries, are
shuffled and added up; no term is ever paired with a pair of sources.

Words are counted per task and source before they are shuffled, so a hot source or a frequent word
costs one row per task. Exact at every size: quotients are taken of decimals.

Defined cases: null text, language and source are empty strings; rows are documents, repeated ones
too; a source without kept terms has all counts zero; a language without kept terms gives pairs of
value 0; a language with one source has no pairs. No documents give no rows; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.texts import utf8
from faultline.staging import stage

MIN_DOCUMENTS = 30
PRIOR = 5
SCALE = 10**9
TOP = 50
_PART_BYTES = 4 << 20
_HELD_TERMS = 400_000
_CELLS = 1 << 21  # shares of a block of entries that one task holds at a time

# Lower-cases A-Z; a-z and all bytes of non-ASCII characters stay; the rest separates.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_COUNTED = "lang string, source string, term binary, n long, docs long"
_SUMS = "lang string, source string, sums array<struct<item:string,value:long>>"


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language by divergence. Part ``term``: the ``top`` kept
    terms whose share in the source exceeds that in the language, by the difference.
    """
    terms = stage(kept_terms(docs, min_documents), "kept-terms")
    groups = stage(_groups(docs, terms), "sources")
    pairs = pair_divergence(terms, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).cast("int").alias("rank")
    over = over_used(terms, groups).select("*", ranked).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.select("*", ranked, F.lit("pair").alias("part"))
        .select(columns)
        .unionByName(over.withColumn("part", F.lit("term")).select(columns))
    )


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, n (in all its documents) and counts: an array of (source, n), by source."""
    counted = docs.select(_named("lang"), _named("source"), utf8().alias("_utf8")).mapInArrow(
        _count_terms, _COUNTED
    )
    return (
        counted.groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term")
        .agg(
            F.sum("n").alias("n"),
            F.sum("docs").alias("docs"),
            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"),
        )
        .filter(F.col("docs") >= min_documents)
        .select("lang", F.col("term").cast("string").alias("term"), "n", "counts")
    )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by source; several rows of one are possible."""
    uses: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        rows = zip(*(column.to_pylist() for column in batch.columns))
        for lang, source, text in rows:
            used = uses[lang, source]
            held -= len(used)
            distinct: set[bytes] = set()
            for words in _word_lists(text):
                used.update(words)
                distinct.update(words)
            documents[lang, source].update(distinct)
            held += len(used)
            if held > _HELD_TERMS:
                yield from _flushed(uses, documents)
                held = 0
    yield from _flushed(uses, documents)


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    folded = text.translate(_LETTERS)
    start = 0
    while len(folded) - start > _PART_BYTES:
        stop = folded.find(b" ", start + _PART_BYTES)
        if stop < 0:
            break
        yield folded[start:stop].split()
        start = stop
    yield folded[start:].split()


def _flushed(uses: dict, documents: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), used in uses.items():
        many = documents[lang, source]
        terms = list(used)
        columns = [
            pa.array([lang] * len(terms), pa.string()),
            pa.array([source] * len(terms), pa.string()),
            pa.array(terms, pa.binary()),
            pa.array(used.values(), pa.int64()),
            pa.array(map(many.__getitem__, terms), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
    uses.clear()
    documents.clear()


def share(n: Column, weight: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / weight), exact beyond 64 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", scaled, weight.cast("decimal(19,0)"))


def _groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Each source of each language: weight (total + PRIOR * terms), the language's own, terms."""
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    sources = (
        terms.select("lang", F.explode("counts").alias("c"))
        .groupBy("lang", F.col("c.source").alias("source"))
        .agg(F.sum("c.n").alias("n"))
    )
    smoothed = F.lit(PRIOR) * F.coalesce("terms", F.lit(0))
    return (
        docs.select(_named("lang"), _named("source"))
        .distinct()
        .join(langs, "lang", "left")
        .join(sources, ["lang", "source"], "left")
        .select(
            "lang",
            "source",
            (F.coalesce("n", F.lit(0)) + smoothed).alias("weight"),
            (F.coalesce("total", F.lit(0)) + smoothed).alias("lang_weight"),
            F.coalesce("terms", F.lit(0)).alias("terms"),
        )
    )


def over_used(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a source uses more than its language does."""
    used = terms.select(
        "lang", F.col("term").alias("item"), F.col("n").alias("all"), F.explode("counts").alias("c")
    ).select("lang", F.col("c.source").alias("source"), "item", "all", F.col("c.n").alias("n"))
    more = share(F.col("n"), F.col("weight")) - share(F.col("all"), F.col("lang_weight"))
    return (
        used.join(groups, ["lang", "source"])
        .select("lang", "source", "item", more.alias("value"))
        .filter("value > 0")
    )


def pair_divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, both ways round."""
    entries = stage(
        terms.groupBy("lang", "counts")
        .agg(F.count(F.lit(1)).alias("times"))
        .repartitionByRange("lang", "counts")
        .sortWithinPartitions("lang", "counts")
        .select("*", F.spark_partition_id().alias("chunk")),
        "count-entries",
    )
    own = F.struct("source", F.when(F.col("terms") > 0, F.col("weight")).alias("n"))
    columns = groups.groupBy("lang").agg(F.sort_array(F.collect_list(own)).alias("counts"))
    # What a chunk needs to know of its language goes before its entries; a language without
    # entries has a chunk of its own.
    chunks = entries.select("lang", "chunk").distinct()
    headed = columns.join(chunks, "lang", "left").select(
        "lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "counts", F.lit(0).cast("long").alias("times")
    )
    sums = (
        entries.select("lang", "chunk", "counts", "times")
        .unionByName(headed)
        .repartition("lang", "chunk")
        .sortWithinPartitions("lang", "chunk", F.col("times") > 0, "counts")
        .mapInArrow(_pair_sums, _SUMS)
    )
    pairs = (
        sums.select("lang", "source", F.explode("sums").alias("s"))
        .groupBy("lang", "source", F.col("s.item").alias("item"))
        .agg(F.sum("s.value").alias("value"))
    )
    both = F.array(
        F.struct("source", "item"),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item")),
    )
    return pairs.select("lang", F.explode(both).alias("p"), "value").select("lang", "p.*", "value")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial divergences of a source from those after it, by language, chunk and block."""
    lang, sources, place, weights = None, [], {}, []
    block: list[list[tuple[int, int]]] = []
    times: list[int] = []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("lang", "counts", "times")]
        for row_lang, counts, n in zip(*columns):
            if n == 0:
                if sources:
                    yield _block_sums(lang, sources, weights, block, times)
                lang, block, times = row_lang, [], []
                sources = [c["source"] for c in counts]
                place = {source: at for at, source in enumerate(sources)}
                weights = [c["n"] for c in counts]
                continue
            if times and (len(times) + 1) * len(sources) > _CELLS:
                yield _block_sums(lang, sources, weights, block, times)
                block, times = [], []
            block.append([(place[c["source"]], c["n"]) for c in counts])
            times.append(n)
    if sources:
        yield _block_sums(lang, sources, weights, block, times)


def _block_sums(
    lang: str, sources: list[str], weights: list[int], block: list, times: list[int]
) -> pa.RecordBatch:
    runs = [runs_of(*column) for column in share_columns(weights, block)] if times else []
    ends = np.concatenate([[0], np.cumsum(times)]).astype(np.int64)
    rows = []
    for a in range(len(sources) - 1):
        some = [
            {"item": sources[b], "value": divergence(runs[a], runs[b], ends) if times else 0}
            for b in range(a + 1, len(sources))
        ]
        rows.append({"lang": lang, "source": sources[a], "sums": some})
    kind = pa.struct([("item", pa.string()), ("value", pa.int64())])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("sums", pa.list_(kind))])
    return pa.RecordBatch.from_pylist(rows, schema)


def share_columns(weights: list[int], block: list) -> Iterator[tuple[np.ndarray, int]]:
    """The shares of each source in the entries of a block, with the number of entries."""
    columns: list[tuple[list[int], list[int]]] = [([], []) for _ in weights]
    for row, counts in enumerate(block):
        for source, n in counts:
            columns[source][0].append(row)
            columns[source][1].append(n)
    for weight, (rows, counts) in zip(weights, columns):
        shares = np.full(len(block), 1 + SCALE * PRIOR // weight, np.int64)
        shares[rows] = [1 + SCALE * (n + PRIOR) // weight for n in counts]
        yield shares, len(block)


def runs_of(shares: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal shares starts, with ``size`` after the last, and their shares."""
    starts = np.concatenate([[0], np.flatnonzero(shares[1:] != shares[:-1]) + 1])
    return np.append(starts, size), shares[starts]


def divergence(a: tuple, b: tuple, ends: np.ndarray) -> int:
    """Sum of the differences over common runs, each times the terms that the run stands for."""
    bounds = np.union1d(a[0], b[0])
    at = bounds[:-1]
    apart = np.abs(
        a[1][np.searchsorted(a[0], at, "right") - 1] - b[1][np.searchsorted(b[0], at, "right") - 1]
    )
    return int((apart * np.diff(ends[bounds])).sum())
