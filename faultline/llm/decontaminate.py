"""Benchmark decontamination by Wu-Manber search over words.

Words are the symbols. Patterns are the distinct windows of ``WINDOW`` item words; the window of
a shorter item is the whole item. Patterns of one length are searched together: a table tells for
each block of two words how far the window may move before it could end a pattern. Where it may
not move, the block's hash leads to the few patterns that end with it, and the words are compared.
Many places of a slice of texts are searched in step, so each step is one array operation.

The benchmark is measured before it is sent to the executors. Beyond ``BLOCK_BYTES`` it is cut
into blocks of distinct (item, text) rows, all documents are searched for one block after the other,
and the spans that were found are written in between. Each block is measured, and dealt again while
it is beyond the bound and has more than one row.

Defined cases: a null or empty text has no words and is not contaminated; items without words
never match; rows that share an item_id are one item; an item without an item_id counts as the
item with an empty name; repeated document rows are judged one by one.
"""

from __future__ import annotations

import hashlib
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.texts import folded_words, slices, unused, utf8
from faultline.staging import stage

WINDOW = 13
BLOCK_WORDS = 2
BLOCK_BYTES = 8 << 20
MIN_SHARE = 20  # contaminated from one hit word in so many
_LANE = 256

_FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"
_JUDGED = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>"
)


class Group(NamedTuple):
    """Patterns of one length with their tables."""

    patterns: np.ndarray  # (pattern, word)
    shift: np.ndarray  # by block hash
    bucket_at: np.ndarray  # by block hash: where its patterns start in ``bucket``
    bucket: np.ndarray
    item_at: np.ndarray  # by pattern: where its items start in ``item``
    item: np.ndarray


class Index(NamedTuple):
    vocabulary: dict[bytes, int]  # from 1; 0 is any other word
    groups: list[Group]
    names: list[str]


def build_index(items: list[tuple[str, bytes]]) -> Index:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for name, text in items:
        ids = [vocabulary.setdefault(word, len(vocabulary) + 1) for word in folded_words(text)]
        if ids:
            number = names.setdefault(name, len(names))
            size = min(WINDOW, len(ids))
            for at in range(len(ids) - size + 1):
                owners = by_length.setdefault(size, {})
                owners.setdefault(tuple(ids[at : at + size]), set()).add(number)
    return Index(vocabulary, [_group(p) for p in by_length.values()], list(names))


def _group(owners: dict[tuple[int, ...], set[int]]) -> Group:
    patterns = np.array(list(owners), np.int64)
    count, size = patterns.shape
    block = min(BLOCK_WORDS, size)
    bits = max(10, (count * size).bit_length() + 2)
    shift = np.full(1 << bits, size - block + 1, np.int64)
    for end in range(block - 1, size):
        np.minimum.at(shift, _hash(patterns, end, block, bits), size - 1 - end)
    last = _hash(patterns, size - 1, block, bits)
    item = [sorted(numbers) for numbers in owners.values()]
    return Group(
        patterns,
        shift,
        np.concatenate([[0], np.cumsum(np.bincount(last, minlength=1 << bits))]),
        np.argsort(last, kind="stable"),
        np.concatenate([[0], np.cumsum([len(i) for i in item])]),
        np.concatenate(item),
    )


def _hash(words: np.ndarray, end: int, block: int, bits: int) -> np.ndarray:
    return _mix([words[:, end - k] for k in range(block)], bits)


def _mix(block: list[np.ndarray], bits: int) -> np.ndarray:
    code = np.zeros(len(block[0]), np.uint64)
    for word in block:
        code = (code ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return (code & np.uint64((1 << bits) - 1)).astype(np.int64)


def occurrences(group: Group, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (start, pattern) at which a pattern of the group occurs in ``ids``."""
    size = group.patterns.shape[1]
    block, bits = min(BLOCK_WORDS, size), len(group.shift).bit_length() - 1
    at = np.arange(size - 1, len(ids), _LANE)
    stop = np.minimum(at + _LANE, len(ids))
    ends, hashes = [], []
    while len(at):
        code = _mix([ids[at - k] for k in range(block)], bits)
        skip = group.shift[code]
        stays = skip == 0
        ends.append(at[stays])
        hashes.append(code[stays])
        at = at + np.maximum(skip, 1)
        inside = at < stop
        at, stop = at[inside], stop[inside]
    end, code = np.concatenate(ends or [[]]).astype(np.int64), np.concatenate(hashes or [[]]).astype(np.int64)
    first, many = group.bucket_at[code], group.bucket_at[code + 1] - group.bucket_at[code]
    which = np.repeat(np.arange(len(end)), many)
    within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    pattern = group.bucket[first[which] + within]
    start = end[which] - size + 1
    for word in range(size):  # direct comparison
        same = ids[start + word] == group.patterns[pattern, word]
        start, pattern = start[same], pattern[same]
    return start, pattern


def search(index: Index, texts: list[bytes]) -> list[tuple]:
    """For each text: number of words, starts and ends of what was found, names of its items."""
    rows: list[tuple] = []
    for lo, hi in slices(texts):
        rows.extend(_search_slice(index, texts[lo:hi]))
    return rows


def _search_slice(index: Index, texts: list[bytes]) -> list[tuple]:
    ids, counts, get = [], [], index.vocabulary.get
    for text in texts:
        words = folded_words(text)
        counts.append(len(words))
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))  # between texts a word that no pattern has
    joined = np.concatenate(ids)
    first = np.cumsum([0, *[n + 1 for n in counts]])
    found: dict[int, tuple[list, list, set]] = {}
    for group in index.groups:
        start, pattern = occurrences(group, joined)
        text_of = np.searchsorted(first, start, side="right") - 1
        size = group.patterns.shape[1]
        for s, p, t in zip(start.tolist(), pattern.tolist(), text_of.tolist()):
            starts, ends, items = found.setdefault(t, ([], [], set()))
            starts.append(s - int(first[t]))
            ends.append(s - int(first[t]) + size)
            items.update(group.item[group.item_at[p] : group.item_at[p + 1]].tolist())
    none: tuple[list, list, set] = ([], [], set())
    return [
        (n, *found.get(t, none)[:2], sorted(index.names[i] for i in found.get(t, none)[2]))
        for t, n in enumerate(counts)
    ]


def judge(n_words: int, starts, ends, items) -> tuple:
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.asarray(ends, np.int64), -1)
    n_hit = int(np.count_nonzero(np.cumsum(change)))
    names = sorted(set(items))
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    dirty = n_hit > 0 and MIN_SHARE * n_hit >= n_words
    return n_words, n_hit, len(names), digest, dirty, names


def with_contamination(
    docs: DataFrame, benchmark: DataFrame, out: str, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, n_items, items_sha256, contaminated, items."""
    blocks = _item_blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        index = _send(docs, blocks[0])

        @F.pandas_udf(_JUDGED)
        def judged(texts: pd.Series) -> pd.DataFrame:
            rows = [judge(*row) for row in search(index.value, list(texts))]
            return pd.DataFrame(rows, columns=_names(_JUDGED))

        return docs.withColumn(out, judged(utf8()))

    spans = [unused(docs, f"_{name}") for name in _names(_FOUND)]
    now = unused(docs, "_found")
    for number, block in enumerate(blocks):
        docs = docs.withColumn(now, _finder(_send(docs, block))(utf8()))
        parts = [F.col(f"{now}.{name}") for name in _names(_FOUND)]
        if number:
            parts[1:] = [F.concat(F.col(s), p) for s, p in zip(spans[1:], parts[1:])]
        docs = stage(docs.withColumns(dict(zip(spans, parts))).drop(now), "contamination")

    @F.pandas_udf(_JUDGED)
    def combined(n: pd.Series, starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = [judge(*row) for row in zip(n, starts, ends, items)]
        return pd.DataFrame(rows, columns=_names(_JUDGED))

    return docs.withColumn(out, combined(*spans)).drop(*spans)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id and the verdict."""
    marked = with_contamination(docs.select("doc_id", "text"), benchmark, "_hit")
    return marked.select("doc_id", "_hit.*")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    verdict = unused(docs, "_contamination")
    marked = with_contamination(docs, benchmark, verdict)
    return marked.filter(~F.col(f"{verdict}.contaminated")).drop(verdict)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _finder(index):
    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(search(index.value, list(texts)), columns=_names(_FOUND))

    return found


def _send(docs: DataFrame, items: DataFrame):
    """The index of a block of items, whose size has been measured, on every executor."""
    rows = items.select("name", "_utf8").collect()
    index = build_index([(row["name"], bytes(row["_utf8"])) for row in rows])
    return docs.sparkSession.sparkContext.broadcast(index)


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Distinct rows of the benchmark in blocks of at most ``block_bytes``, or of one row."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(name.alias("name"), utf8().alias("_utf8"))
    size, _ = _measured(items).first()
    if size <= block_bytes:
        return [items]
    items = stage(items.distinct(), "benchmark")
    whole = _measured(items).first()
    return _dealt(items, *whole, block_bytes, 0)


def _measured(items: DataFrame, *keys: Column) -> DataFrame:
    """Bytes and number of items."""
    size = F.coalesce(F.sum(F.octet_length("_utf8") + 64), F.lit(0))
    return items.groupBy(*keys).agg(size.alias("size"), F.count(F.lit(1)).alias("many"))


def _dealt(items: DataFrame, size: int, many: int, block_bytes: int, depth: int) -> list[DataFrame]:
    if size <= block_bytes or many == 1:
        return [items]
    # Dealt out by a hash that differs by depth, so twice as many blocks keep nearly all below the bound.
    count = 2 * -(-size // block_bytes)
    block = F.pmod(F.xxhash64("name", "_utf8", F.lit(depth)), F.lit(count))
    parts = _measured(items, block.alias("block")).orderBy("block").collect()
    return [
        dealt
        for part in parts
        for dealt in _dealt(
            items.filter(block == part["block"]), part["size"], part["many"], block_bytes, depth + 1
        )
    ]
