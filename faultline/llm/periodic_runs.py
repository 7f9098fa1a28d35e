"""Periodic runs of words, found by an enhanced suffix array and its branching tandem repeats.

The words of many documents share one suffix array, in which suffixes of two documents never
compare equal. It is built by prefix doubling: only suffixes whose prefix still has a double go on,
and the ranks of each round are kept. They give the common prefixes of neighbours, from the longest
round down, and with these the intervals of the array, as pairs of nearest smaller values.

For each interval of depth d, every suffix i outside the interval's largest child asks the inverse
array whether i + d or i - d lies in the interval too, but not in the same child. Then the words
between are a square of period d that cannot be moved to the right. Rotating it to the left as far
as the words allow gives the run, and squares that rotate to the same stretch are merged into one
run with the smallest of their periods. Nothing here walks a tree or looks at one suffix at a time.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q, of
at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods. Collapsing drops what is in any run after
that run's first period.

Defined cases: a null or empty text, or one of white space, has no words and no runs, and collapses
to an empty text; repeated rows and rows without a doc_id are documents of their own; other columns
are not read. A document's words are held by one task, with about 4 * log2(words) bytes each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.texts import narrow, slices

MIN_WORDS = 6
MIN_PERIODS = 4
_BATCH_BYTES = 2 << 20
_ASKED_AT_A_TIME = 1 << 20
_JUMPS = 8

_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_WHITE = r"[ \t\n\x0B\f\r]+"


def periodic_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period) and collapsed text.

    Runs come by start, then period; starts are word numbers from 0.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, _BATCH_BYTES):
                yield _found(batch.column(0)[lo:hi], texts[lo:hi], min_words, min_periods)

    found = narrow(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(find, _FOUND)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _found(doc_ids: pa.Array, texts: list[bytes], min_words: int, min_periods: int) -> pa.RecordBatch:
    number = defaultdict(count().__next__)
    words = [text.split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
    start, stop, period = word_runs(ids, sizes, min_words, min_periods)

    first = np.cumsum(sizes) - sizes
    owner = np.searchsorted(first, start, "right") - 1
    # An empty document shares its first place with the one after it, which owns the run.
    offsets = np.searchsorted(owner, np.arange(len(words) + 1))
    # A word is dropped where more runs have passed their first period than have ended.
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, stop, -1)
    kept = np.cumsum(depth[:-1]) == 0
    collapsed = []
    for at, doc in enumerate(words):
        if offsets[at] < offsets[at + 1]:
            doc = compress(doc, kept[first[at] : first[at] + len(doc)].tolist())
        collapsed.append(b" ".join(doc))
    runs = pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in (start - first[owner], stop - start, period)],
        names=["start", "length", "period"],
    )
    columns = [
        doc_ids,
        pa.array(sizes, pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
        pa.array(collapsed, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def word_runs(
    ids: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and period of the runs in documents of ``sizes`` words, laid end to end."""
    none = np.empty(0, np.int64)
    if len(ids) == 0:
        return none, none, none
    stops = np.cumsum(sizes)
    stop_of = np.repeat(stops, sizes)
    begin_of = np.repeat(stops - sizes, sizes)
    ranks = prefix_ranks(ids, begin_of, stop_of)
    at, period = branching_squares(ranks, begin_of, stop_of)

    start = at.copy()
    for k in range(len(ranks) - 1, -1, -1):
        back = np.maximum(start - (1 << k), 0)
        same = (start - (1 << k) >= begin_of[at]) & (ranks[k][back] == ranks[k][back + period])
        start = np.where(same, back, start)
    stop = at + 2 * period
    long_enough = stop - start >= np.maximum(min_words, min_periods * period)
    start, stop, period = start[long_enough], stop[long_enough], period[long_enough]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[fresh], stop[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def prefix_ranks(ids: np.ndarray, begin_of: np.ndarray, stop_of: np.ndarray) -> list[np.ndarray]:
    """For each round k the ranks of all suffixes by their first 2**k words; the last are unique.

    A rank is the place in the suffix array where the suffixes with that prefix begin; equal ranks
    mean equal words of one document. One more place at the end belongs to no suffix.
    """
    n = len(ids)
    rank = np.full(n + 1, -1, np.int32)
    active, old = np.arange(n), np.zeros(n, np.int64)
    key = begin_of * (int(ids.max()) + 1) + ids
    ranks: list[np.ndarray] = []
    while len(active):
        order = np.argsort(key)
        active, old, key = active[order], old[order], key[order]
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        places = np.arange(len(active))
        first = np.maximum.accumulate(np.where(fresh, places, 0))
        if ranks:
            opens = np.ones(len(active), bool)
            opens[1:] = old[1:] != old[:-1]
            first_old = np.maximum.accumulate(np.where(opens, places, 0))
            new = old + first - first_old
        else:
            new = first
        rank = rank.copy()
        rank[active] = new
        ranks.append(rank)
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        active, old = active[shared], new[shared]
        after = active + (1 << (len(ranks) - 1))
        follow = np.where(after < stop_of[active], rank[np.minimum(after, n)], -1)
        key = old * (n + 1) + follow + 1
    return ranks


def common_prefixes(ranks: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it; none for the first."""
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    begins = a.copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = np.flatnonzero(ranks[k][a] == ranks[k][b])
        a[same] += 1 << k
        b[same] += 1 << k
    return np.concatenate([[0], a - begins])


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place with a value above zero, the nearest one before it with a smaller value.

    The first place holds a value below zero. Minima of aligned blocks of 2**k places are climbed
    until one is small enough, and then descended, for all places that a few jumps leave open.
    """
    minima = [values]
    while len(minima[-1]) > 1:
        blocks = minima[-1]
        if len(blocks) % 2:
            blocks = np.append(blocks, blocks[-1])
        minima.append(np.minimum(blocks[::2], blocks[1::2]))
    near = np.arange(len(values)) - 1
    near[0] = 0
    far = np.flatnonzero((values[near] >= values) & (values > 0))
    for _ in range(_JUMPS):
        near[far] = near[near[far]]
        far = far[values[near[far]] >= values[far]]
    limit, block, found = values[far], near[far] + 1, np.full(len(far), -1)
    for k, blocks in enumerate(minima):
        up = np.flatnonzero(found < 0)
        if not len(up):
            break
        here = block[up]
        hit = (here % 2 == 1) & (blocks[np.maximum(here - 1, 0)] < limit[up])
        found[up[hit]] = k
        block[up] = np.where(hit, here - 1, here >> 1)
    for k in range(int(found.max(initial=0)) - 1, -1, -1):
        down = np.flatnonzero(found > k)
        right = np.minimum(2 * block[down] + 1, len(minima[k]) - 1)
        block[down] = np.where(minima[k][right] < limit[down], right, 2 * block[down])
    near[far] = block
    return near


def branching_squares(
    ranks: list[np.ndarray], begin_of: np.ndarray, stop_of: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Start and period d of all squares whose halves lie in different children of an interval
    of depth d, which are those that cannot be rotated to the right."""
    n = len(begin_of)
    inverse = ranks[-1][:n]
    suffixes = np.empty(n, np.int64)
    suffixes[inverse] = np.arange(n)
    common = np.concatenate([common_prefixes(ranks, suffixes), [0]])
    common[0] = common[-1] = -1
    left, right = _nearest_smaller(common), n - _nearest_smaller(common[::-1])[::-1]

    # Places that separate children, by interval. The first child begins where the interval does.
    parts = np.flatnonzero(common > 0)
    parts = parts[np.lexsort((parts, right[parts], left[parts]))]
    low, high, depth = left[parts], right[parts], common[parts]
    opens = np.ones(len(parts), bool)
    opens[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    closes = np.append(opens[1:], True)[: len(parts)]
    after = np.where(closes, high, np.append(parts[1:], 0)[: len(parts)])
    heads = np.flatnonzero(opens)
    interval = np.cumsum(opens) - 1
    child_low = np.concatenate([low[heads], parts])
    child_high = np.concatenate([parts[heads], after])
    owner = np.concatenate([np.arange(len(heads)), interval])

    sizes = child_high - child_low
    order = np.lexsort((-sizes, owner))
    largest = np.ones(len(order), bool)
    largest[1:] = owner[order][1:] != owner[order][:-1]
    small = order[~largest]
    found_at, found_period = [], []
    for some in _blocks(small, sizes[small]):
        times = sizes[some]
        skipped = np.cumsum(times) - times
        member = np.arange(times.sum()) - np.repeat(skipped - child_low[some], times)
        of = np.repeat(some, times)
        head = heads[owner[of]]
        i, d = suffixes[member], depth[head]
        for step in (d, -d):
            j = i + step
            inside = np.flatnonzero((j >= begin_of[i]) & (j < stop_of[i]))
            place, near, child = inverse[j[inside]], head[inside], of[inside]
            meets = (place >= low[near]) & (place < high[near])
            meets &= (place < child_low[child]) | (place >= child_high[child])
            hit = inside[meets]
            found_at.append(np.minimum(i[hit], j[hit]))
            found_period.append(d[hit])
    if not found_at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_period)


def _blocks(items: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """``items`` in order, cut so that the sizes of a block sum to about _ASKED_AT_A_TIME."""
    block = np.cumsum(sizes) // _ASKED_AT_A_TIME
    yield from np.split(items, np.flatnonzero(block[1:] != block[:-1]) + 1)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from some word on.

    With n words, h the crc32 of the doc_id's digits and g = h / 10: where h % 10 is 0, word i from
    a = g % n on becomes word a + (i - a) % p, for p = 1 + (n - a) / (3 + g % 8), and the words are
    joined by one space. Texts of rows without a doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), _WHITE), lambda w: w != "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    picked = F.when((F.col("h") % 10 == 0) & F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), words)
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    rows = rows.select("doc_id", "text", g.alias("g"), picked.alias("w"))
    rows = rows.select("*", n.cast("long").alias("n"), (F.col("g") % n).alias("a"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p")
    rows = rows.select("*", p)
    a, p = F.col("a"), F.col("p")
    place = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    )
    planted = F.array_join(F.transform(place, lambda i: F.get("w", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The report of ``periodic_runs``: number of runs, the longest of them, and two digests."""
    best = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")),
        )
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
