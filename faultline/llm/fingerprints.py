"""Document fingerprints: SimHash over weighted term hashes, searched by permuted block tables.

A text's words (lower-cased A-Z, digits and any characters beyond ASCII) are cut into pieces of at
most ``PIECE`` bytes. A term is a piece with the piece before it, and weighs as many votes as both
have bytes, so that pairs of short, common words count for little, times the binary digits of its
number of occurrences, so that a repeated line does not outvote the rest. Each term has a hash of
``BITS`` bits; every bit of a fingerprint is set if the set bits of the terms' hashes outweigh the
others. Votes add up, so a text is read in parts of a megabyte, with occurrences counted by part.
Nothing depends on other texts: equal texts have equal fingerprints in any corpus.

Search. The bits are cut into ``BLOCKS`` blocks. Fingerprints within ``RADIUS`` bits agree in at
least BLOCKS - RADIUS whole blocks, so for each choice of so many blocks there is a table of all
distinct fingerprints with these blocks permuted to the front, which are the table's key. Inside a
key all members are compared on all bits. A pair that meets in several tables is counted in the first
only, so numbers of neighbours simply add up, and no pair is ever written. A key with more than
``BUCKET`` members goes a second way: its members are split by hash and each two parts meet in a
task of their own, which is exact as well.

Copies share a fingerprint and are one member with a multiplicity, so large groups of copies cost
nothing. With B bits in the key, a key of N random fingerprints has N / 2**B members: take more
BLOCKS, hence more tables, for larger corpora.

Neighbours in the order of documents: rows are range-partitioned and sorted by (doc_id descending,
digest of the text), each task streams its range and keeps one row back, and what stands at the
edges of ranges, two rows each, is joined by range number afterwards.

Defined cases: null and empty texts and those without words have fingerprint zero; texts without a
doc_id come last, rows that share a doc_id in the order of a digest of their text, equal rows in any
order; a single row is its own next. No documents give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.texts import _FOLD, slices, utf8
from faultline.staging import stage

BITS = 128
PIECE = 12
RADIUS = 4
BLOCKS = 5
BUCKET = 4096

_PART_BYTES = 1 << 20
_TERMS_AT_A_TIME = 1 << 15
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = 32
_SPACES = re.compile(rb" *")

_TABLES = "print binary, near long, key long, turned binary, n long"
_WALKED = (
    "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, "
    "near_edited double, near_next double, chunk int, head binary, tail binary"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and print (BITS / 8 bytes)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [p.tobytes() for p in text_prints(batch.column(1).to_pylist())]
            columns = [batch.column(0), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_utf8"))
    return rows.mapInArrow(mark, "doc_id long, print binary")


def text_prints(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of UTF-8 texts, a row of bytes each."""
    votes = np.zeros((len(texts), BITS), np.int64)
    total = np.zeros(len(texts), np.int64)
    parts: list[tuple[int, bytes, bool]] = []
    for at, text in enumerate(texts):
        parts.extend((at, part, more) for part, more in _parts(text.translate(_FOLD)))
    for lo, hi in slices([part for _, part, _ in parts], _PART_BYTES):
        _vote(parts[lo:hi], votes, total)
    return np.packbits(2 * votes > total[:, None], axis=1)


def _parts(folded: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a folded text, and whether they begin with the last piece of the part before."""
    start, before = 0, b""
    while len(folded) - start > _PART_BYTES:
        start = _SPACES.match(folded, start).end()
        stop = folded.rfind(b" ", start, start + _PART_BYTES)
        if stop <= start:  # one word: cut between two of its pieces
            stop = start + _PART_BYTES // PIECE * PIECE
        part = before + folded[start:stop]
        yield part, bool(before)
        words = part.split()
        last = words[-1] if words else b""
        before = last[(len(last) - 1) // PIECE * PIECE :] + b" " if last else b""
        start = stop
    yield before + folded[start:], bool(before)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _vote(parts: list[tuple[int, bytes, bool]], votes: np.ndarray, total: np.ndarray) -> None:
    """Add the votes of the terms of ``parts`` (document, folded text, whether it goes on)."""
    joined = b" ".join(part for _, part, _ in parts) + b" "
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(part) + 1 for _, part, _ in parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes

    word = data != _SPACE
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edges = np.concatenate([[0], edges])
    first, last = edges[::2], edges[1::2]
    pieces = -(-(last - first) // PIECE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + PIECE * nth
    stop = np.minimum(start + PIECE, np.repeat(last, pieces))
    if not len(start):
        return
    power, inverse = _powers(1 << int(len(data) + 1).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    code = _mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))

    part = np.searchsorted(begins, start, "right") - 1
    opens = np.ones(len(start), bool)
    opens[1:] = part[1:] != part[:-1]
    length = stop - start
    weight = length + np.where(opens, 0, np.concatenate([[0], length[:-1]]))
    before = np.where(opens, np.uint64(0), np.concatenate([[np.uint64(0)], code[:-1]]))
    term = _mixed(before * np.uint64(_BASE) + code)
    # The piece that a part repeats from the one before it opens no term of its own.
    again = np.fromiter((more for _, _, more in parts), bool, len(parts))[part] & opens
    weight[again] = 0

    # Equal terms of a part are one, sorted by part; 44 bits tell terms of one part apart.
    key = (part.astype(np.uint64) << np.uint64(44)) | (term >> np.uint64(20))
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(heads, len(key)))
    first = order[heads]
    term, part, weight = term[first], part[first], weight[first] * np.frexp(times)[1]

    owner = np.fromiter((at for at, _, _ in parts), np.int64, len(parts))[part]
    for lo in range(0, len(term), _TERMS_AT_A_TIME):
        some = term[lo : lo + _TERMS_AT_A_TIME]
        both = np.stack([some, _mixed(some + np.uint64(_BASE))], axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1)
        doc = owner[lo : lo + len(some)]
        cuts = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
        # Weights and blocks are small, so single precision is exact.
        heavy = weight[lo : lo + len(some)].astype(np.float32)
        real = bits.astype(np.float32)
        for a, b in zip(cuts[:-1], cuts[1:]):
            votes[doc[a]] += (heavy[a:b] @ real[a:b]).astype(np.int64)
            total[doc[a]] += int(heavy[a:b].sum())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of rows of fingerprints."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def near_counts(
    prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET
) -> DataFrame:
    """For each fingerprint of ``prints`` (print, n: how many documents have it) with a neighbour:
    print and near, the number of documents with another fingerprint within ``radius`` bits."""
    tables = tuple(combinations(range(blocks), blocks - radius))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(_matrix(batch.column(0)), axis=1)
            for number, chosen in enumerate(tables):
                order, width = _permutation(chosen, blocks)
                turned = np.packbits(bits[:, order], axis=1)
                yield _table_rows(table_keys(turned, number, width), turned, batch.column(1))

    filed = prints.mapInArrow(file, "key long, turned binary, n long")
    met = stage(
        filed.repartition("key")
        .sortWithinPartitions("key", "turned")
        .mapInArrow(lambda batches: _meet(batches, tables, blocks, radius, bucket), _TABLES),
        "table-neighbours",
    )
    found = met.filter("print is not null").select("print", "near")
    crowded = met.filter("key is not null").select("key", "turned", "n")
    sizes = crowded.groupBy("key").agg(F.ceil(2 * F.count(F.lit(1)) / bucket).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("turned"), F.col("shards")).cast("int")
    cells = (
        crowded.join(sizes, "key")
        .select("key", "turned", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
        .select(
            "key",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            (F.col("own") > F.col("other")).alias("second"),
            "turned",
            "n",
        )
    )
    split = cells.groupBy("key", "a", "b").applyInArrow(
        lambda rows: _cell(rows, tables, blocks, radius), "print binary, near long"
    )
    return found.unionByName(split).groupBy("print").agg(F.sum("near").alias("near"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _spans(blocks: int) -> list[np.ndarray]:
    return np.array_split(np.arange(BITS), blocks)


def _permutation(chosen: tuple[int, ...], blocks: int) -> tuple[np.ndarray, int]:
    """The bits with the chosen blocks first, and how many bits these have."""
    spans = _spans(blocks)
    rest = [spans[at] for at in range(blocks) if at not in chosen]
    front = np.concatenate([spans[at] for at in chosen])
    return np.concatenate([front, *rest]), len(front)


def table_keys(turned: np.ndarray, number: int, width: int) -> np.ndarray:
    """The first ``width`` bits, and the table's number. Long keys are cut to what a long holds,
    which only lets more members meet."""
    first = np.ascontiguousarray(turned[:, :8]).view(">u8")[:, 0].astype(np.uint64)
    bits = min(width, 50)
    return ((first >> np.uint64(64 - bits)) | np.uint64(number << 50)).astype(np.int64)


def _table_rows(key: np.ndarray, turned: np.ndarray, n: pa.Array) -> pa.RecordBatch:
    rows = pa.array([row.tobytes() for row in turned], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), rows, n], names=["key", "turned", "n"])


def _words(turned: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(turned).view(np.uint64).reshape(len(turned), -1)


@lru_cache(maxsize=256)
def _agreements(number: int, tables: tuple, blocks: int) -> tuple[np.ndarray, ...]:
    """What the table and each earlier one has in front, as masks over this table's bits."""
    order, _ = _permutation(tables[number], blocks)
    spans = _spans(blocks)
    masks = []
    for chosen in tables[: number + 1]:
        bits = np.isin(order, np.concatenate([spans[at] for at in chosen]))
        masks.append(_words(np.packbits(bits)[None, :])[0])
    return tuple(masks)


def _linked(a: np.ndarray, b: np.ndarray, number: int, tables: tuple, blocks: int, radius: int) -> np.ndarray:
    """Which rows of words are within the radius, agree in this table and in no earlier one."""
    apart = a ^ b
    good = np.bitwise_count(apart).sum(axis=-1) <= radius
    at = np.flatnonzero(good)
    *earlier, own = _agreements(number, tables, blocks)
    at = at[~(apart[at] & own).any(axis=-1)]
    for mask in earlier:
        if not len(at):
            break
        at = at[(apart[at] & mask).any(axis=-1)]
    out = np.zeros(len(good), bool)
    out[at] = True
    return out


def _unturned(turned: np.ndarray, number: int, tables: tuple, blocks: int) -> list[bytes]:
    order, _ = _permutation(tables[number], blocks)
    bits = np.empty((len(turned), BITS), np.uint8)
    bits[:, order] = np.unpackbits(turned, axis=1)
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def _meet(batches, tables: tuple, blocks: int, radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Neighbours inside the keys of sorted rows; those of crowded keys come back as they are."""
    held: list[pa.RecordBatch] = []  # the last key so far, which may go on
    held_key = crowded = None
    for batch in batches:
        if crowded is not None:
            end = int(np.searchsorted(batch.column(0).to_numpy(), crowded, "right"))
            yield _crowded_rows(batch.slice(0, end))
            batch = batch.slice(end)
        if not len(batch):
            continue
        crowded, keys = None, batch.column(0).to_numpy()
        last = int(keys[-1])
        if held_key != last:
            at = int(np.searchsorted(keys, last))
            yield from _inside([*held, batch.slice(0, at)], tables, blocks, radius, bucket)
            held, held_key, batch = [], last, batch.slice(at)
        held.append(batch)
        if sum(map(len, held)) > bucket:
            yield from map(_crowded_rows, held)
            held, held_key, crowded = [], None, last
    if held:
        yield from _inside(held, tables, blocks, radius, bucket)


def _crowded_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
    none = [pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, *rows.columns], names=["print", "near", "key", "turned", "n"])


def _near_rows(prints: list[bytes], near: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.array(prints, pa.binary()),
        pa.array(near, pa.int64()),
        pa.nulls(len(prints), pa.int64()),
        pa.nulls(len(prints), pa.binary()),
        pa.nulls(len(prints), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["print", "near", "key", "turned", "n"])


def _inside(parts: list, tables: tuple, blocks: int, radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(parts).combine_chunks()
    if not len(rows):
        return
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    sizes = np.diff(bounds)
    many = sizes > bucket
    for at in np.flatnonzero(many):
        part = rows.slice(int(bounds[at]), int(sizes[at]))
        yield _crowded_rows(part.to_batches()[0])
    open_rows = np.flatnonzero(np.repeat((sizes > 1) & ~many, sizes))
    if not len(open_rows):
        return
    key, n = key[open_rows], n[open_rows]
    turned = _matrix(rows["turned"].take(pa.array(open_rows)).combine_chunks())
    words, near = _words(turned), np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    for step in range(1, len(key)):
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        for number in np.unique(key[left] >> 50):
            i = left[key[left] >> 50 == number]
            i = i[_linked(words[i], words[i + step], int(number), tables, blocks, radius)]
            np.add.at(near, i, n[i + step])
            np.add.at(near, i + step, n[i])
    yield from _named(key, turned, near, tables, blocks)


def _named(key: np.ndarray, turned: np.ndarray, near: np.ndarray, tables: tuple, blocks: int):
    for number in np.unique(key[near > 0] >> 50):
        at = np.flatnonzero((near > 0) & (key >> 50 == number))
        yield _near_rows(_unturned(turned[at], int(number), tables, blocks), near[at])


def _cell(rows: pa.Table, tables: tuple, blocks: int, radius: int) -> pa.Table:
    """Neighbours between two parts of a crowded key, or inside one part."""
    number = int(rows["key"][0].as_py() >> 50)
    turned, n = _matrix(rows["turned"].combine_chunks()), rows["n"].to_numpy()
    second = rows["second"].to_numpy()
    words, near = _words(turned), np.zeros(len(n), np.int64)
    alone = rows["a"][0].as_py() == rows["b"][0].as_py()
    right = np.flatnonzero(second)
    for i in np.flatnonzero(~second):
        j = np.arange(i + 1, len(n)) if alone else right
        j = j[_linked(words[i], words[j], number, tables, blocks, radius)]
        near[i] += n[j].sum()
        near[j] += n[i]
    at = np.flatnonzero(near)
    columns = [pa.array(_unturned(turned[at], number, tables, blocks), pa.binary()), pa.array(near[at], pa.int64())]
    return pa.table(columns, names=["print", "near"])


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and its neighbours.

    The edited text ends in the beginning of the next document by descending doc_id (the first
    after the last) instead of its own last third. ``near_edited`` and ``near_next`` are the shares
    of equal bits with the edited and the next text's fingerprints; ``n_near`` is the number of
    other documents within RADIUS bits, copies included.
    """
    rows = stage(_with_edges(stage(_walk(docs), "walked-documents")), "fingerprinted-documents")
    prints = stage(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n")), "distinct-prints")
    near = prints.join(near_counts(prints), "print", "left").select(
        "print", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near")
    )
    return rows.join(near, "print").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
    )


def _walk(docs: DataFrame) -> DataFrame:
    """Documents in order with what they share with the next one. The first and the last row of a
    range carry their text (head, tail); the last has no next one yet, and no print until then."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("_utf8"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        # Equal rows may be many; this lets them fall into several ranges.
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("_digest").asc(), F.col("_row").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "_utf8").mapInArrow(_walk_range, _WALKED)


def _walk_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId()
    held: tuple | None = None
    head: bytes | None = None
    for batch in batches:
        ids, texts = (column.to_pylist() for column in batch.columns)
        for lo, hi in slices(texts, _PART_BYTES):
            some = list(zip(ids[lo:hi], texts[lo:hi]))
            if held is None:
                head = some[0][1]
            else:
                some.insert(0, held)
            held = some[-1]
            if len(some) > 1:
                yield _walked([i for i, _ in some[:-1]], [t for _, t in some], chunk)
    if held is not None:
        doc_id, text = held
        columns = [[doc_id], *[[None]] * 6, [chunk], [head], [text]]
        yield _walked_batch(columns)


def _walked(ids: list, texts: list[bytes], chunk: int | None) -> pa.RecordBatch:
    """Rows for all texts but the last, each with the one after it."""
    edited, chars = [], []
    for text, following in zip(texts, texts[1:]):
        new, size = edited_text(text, following)
        edited.append(new)
        chars.append(size)
    prints, changed = text_prints(texts), text_prints(edited)
    nothing = [None] * len(ids)
    columns = [
        ids,
        chars,
        [hashlib.sha256(new).hexdigest() for new in edited],
        [p.tobytes() for p in prints[:-1]],
        [p.tobytes() for p in changed],
        likeness(prints[:-1], changed),
        likeness(prints[:-1], prints[1:]),
        [chunk] * len(ids),
        nothing,
        nothing,
    ]
    return _walked_batch(columns)


def _walked_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    kinds += [pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
    names = [field.split()[0] for field in _WALKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def edited_text(text: bytes, following: bytes) -> tuple[bytes, int]:
    """``text`` with its last third replaced by the beginning of ``following``; its code points."""
    own = text.decode("utf-8", "surrogateescape")
    cut = len(own) // 3
    # A character has at most four bytes, so the beginning need not be decoded whole.
    new = following[: 4 * cut].decode("utf-8", "surrogateescape")
    return (own[: len(own) - cut] + new[:cut]).encode("utf-8", "surrogateescape"), len(own)


def _with_edges(walked: DataFrame) -> DataFrame:
    """The rows inside the ranges, and those at their ends with the first text of the next range."""
    ends = walked.filter("tail is not null").select("chunk", "doc_id", "head", "tail")
    # One row per range.
    order = Window.orderBy("chunk")
    first = F.min("chunk").over(Window.partitionBy())
    following = ends.select("chunk", F.coalesce(F.lead("chunk").over(order), first).alias("after"))
    heads = ends.select(F.col("chunk").alias("after"), F.col("head").alias("following"))
    pairs = ends.select("chunk", "doc_id", "tail").join(following, "chunk").join(heads, "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, beginning in zip(*(c.to_pylist() for c in batch.columns)):
                yield _walked([doc_id], [text, beginning], None)

    edges = pairs.select("doc_id", "tail", "following").mapInArrow(finish, _WALKED)
    return walked.filter("tail is null").unionByName(edges).drop("chunk", "head", "tail")
