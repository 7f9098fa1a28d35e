"""Suffix-array dedup: bytes inside a 100-byte string that also starts earlier are removed.

1. Anchors. In every string of ``LENGTH`` bytes the smallest hashed ``ANCHOR``-byte piece is its
   anchor, so equal strings have equal anchors at equal places. The consecutive strings of one
   anchor are one record: where they start, and a hash of the context they span. Records meet by
   anchor. An anchor that occurs once repeats nothing; of equal contexts all but the first are
   later copies as a whole. Contexts that differ but share their anchor go on, one of each.
2. Shards. Each task that reads such contexts writes, for every bucket of anchors, the
   Burrows-Wheeler transform of the contexts it holds. A symbol is a word of eight bytes, counted
   from the anchor, so contexts of one anchor are in step.
3. Merge. The transforms of a bucket are merged by refining their interleave: starting from any
   order, a stable deal of the merged transform by symbol sorts the suffixes by one symbol more.
   Nothing is sorted again by its text. The round in which two neighbours part is their longest
   common prefix; intervals that never part within a string's full words are repeated, and the
   few bytes before and after these words are compared directly.
4. All spans of a document are joined to its text and cut out.

Rows meet in tasks by the hash of their anchor, sorted, and are decided a part at a time; hot
contexts are folded together before they are sent. Anchors with more than ``HOT`` different contexts go another exact way: each of
their strings is a row under its 128-bit digest, and the first start per digest is a plain minimum.

Defined cases: null and empty texts and those under LENGTH bytes lose nothing. Documents come in
the order of (doc_id, hash of the text), nulls first. Equal rows are one document: both lose what
an earlier document or an earlier start has, neither counts as a copy of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.line_dedup import KEY, document_key
from faultline.llm.texts import utf8
from faultline.staging import stage

LENGTH = 100
ANCHOR = 20
WORD = 8
BUFFER = 1 << 20  # bytes hashed at a time
FLUSH = 32 << 20  # bytes of text whose records are folded together before they are sent
ROWS = 200_000  # sorted rows that are decided at a time
BUCKET_CONTEXTS = 10_000
HOT = 20_000

_BASE = 0x9E3779B97F4A7C15
_RECORD = {"anchor": "<u8", "context": "<u8", "doc": "<u4", "at": "<i8", "before": "u1", "owned": "u1"}
_CONTEXT = {"anchor": "<u8", "doc": "<u4", "at": "<i8", "before": "u1", "owned": "u1"}
_DOCS = dict.fromkeys(KEY, "<i8")
_SPAN = {**_DOCS, "start": "<i8", "end": "<i8"}

Columns = dict[str, np.ndarray]


# --- step 1: records by anchor ---------------------------------------------------------------


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, powers of its inverse (both modulo 2**64), a value for each byte."""
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(BUFFER + 1, base, np.uint64)
        factors[0] = 1
        powers.append(np.multiply.accumulate(factors))
    values = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
    return *powers, values * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def records(parts: list[tuple[int, int, bytes]]) -> Columns:
    """Records of (document, offset, bytes) parts, together at most BUFFER bytes."""
    data = np.frombuffer(b"".join(part for _, _, part in parts), np.uint8)
    if len(data) < LENGTH:
        return {name: np.empty(0, kind) for name, kind in _RECORD.items()}
    powers, inverse, values = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    pieces = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(sums) - ANCHOR])

    # The lowest piece of each string, the leftmost of equal ones: the place is in the low bits.
    places = np.uint64(BUFFER - 1)
    least = (pieces & ~places) | np.arange(len(pieces), dtype=np.uint64)
    window, span = LENGTH - ANCHOR + 1, 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    anchor = (least & places).astype(np.int64)

    sizes = np.array([len(part) for _, _, part in parts])
    starts = np.cumsum(sizes) - sizes
    part_of = np.repeat(np.arange(len(parts)), sizes)
    p = np.flatnonzero(part_of[: len(anchor)] == part_of[LENGTH - 1 :])
    if not len(p):
        return {name: np.empty(0, kind) for name, kind in _RECORD.items()}
    anchor = anchor[p]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (np.diff(p) != 1)) + 1
    low, high = p[np.r_[0, cut]], p[np.r_[cut - 1, len(p) - 1]]
    at, part = anchor[np.r_[0, cut]], part_of[low]
    shift = np.array([offset for _, offset, _ in parts])[part] - starts[part]
    return {
        "anchor": pieces[at],
        "context": _mix((sums[high + LENGTH] - sums[low]) * inverse[low]),
        "doc": np.array([doc for doc, _, _ in parts], np.uint32)[part],
        "at": at + shift,
        "before": (at - low).astype(np.uint8),
        "owned": (high - low + 1).astype(np.uint8),
    }


def _buffers(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts of at most BUFFER bytes together; parts of a long text overlap by LENGTH - 1."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for doc, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), BUFFER - LENGTH + 1):
            part = text[offset : offset + BUFFER]
            if held and size + len(part) > BUFFER:
                yield held
                held, size = [], 0
            held.append((doc, offset, part))
            size += len(part)
    if held:
        yield held


def _joined(columns: list[Columns], kinds: dict[str, str]) -> Columns:
    return {
        name: np.concatenate([c[name] for c in columns]) if columns else np.empty(0, kind)
        for name, kind in kinds.items()
    }


def _packed(columns: Columns, kinds: dict[str, str]) -> bytes:
    data = b"".join(columns[name].astype(kind).tobytes() for name, kind in kinds.items())
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(blob: bytes, rows: int, kinds: dict[str, str]) -> Columns:
    data, at, columns = zstandard.ZstdDecompressor().decompress(blob), 0, {}
    for name, kind in kinds.items():
        columns[name] = np.frombuffer(data, kind, rows, at)
        at += rows * np.dtype(kind).itemsize
    return columns


def _first_of_equal(names: list[str], columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of names, the document, at; which start a group of equal names; later copies.

    A later copy starts elsewhere than the group's first row.
    """
    order = np.lexsort([columns[name] for name in [*names, *KEY, "at"][::-1]])
    return order, *_groups(names, columns, order)


def _groups(
    names: list[str], columns: Columns, order: np.ndarray | slice = slice(None)
) -> tuple[np.ndarray, np.ndarray]:
    """Of ordered rows, which start a group of equal names, and which are later copies."""
    n = len(columns[names[0]])
    first = np.zeros(n, bool)
    first[:1] = True
    for name in names:
        own = columns[name][order]
        first[1:] |= own[1:] != own[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    later = np.zeros(n, bool)
    for name in (*KEY, "at"):
        own = columns[name][order]
        later |= own != own[head]
    return first, later


def _merged(spans: Columns) -> Columns:
    """Spans of a document that overlap or touch as one, ordered by document and start."""
    order = np.lexsort([spans[name] for name in [*KEY, "start"][::-1]])
    if not len(order):
        return spans
    spans = _take(spans, order)
    start, end, new_doc = spans["start"], spans["end"], _new_docs(spans)
    far = (np.cumsum(new_doc) - 1) * (int(end.max()) + 2)  # documents one after the other
    reach = np.maximum.accumulate(far + end)
    opens = np.flatnonzero(np.r_[True, (far + start)[1:] > reach[:-1]])
    last = np.r_[opens[1:] - 1, len(order) - 1]
    ends = (reach - far)[last]
    return {**_take(spans, opens), "end": ends}


def _new_docs(rows: Columns) -> np.ndarray:
    """Which of the rows, sorted by document, are the first of theirs."""
    new = np.ones(len(rows["id"]), bool)
    new[1:] = np.logical_or.reduce([rows[name][1:] != rows[name][:-1] for name in KEY])
    return new


def _covered(rows: Columns) -> Columns:
    """All strings of the records, as spans."""
    start = rows["at"] - rows["before"]
    end = start + rows["owned"] - 1 + LENGTH
    return {**{name: rows[name] for name in KEY}, "start": start, "end": end}


def _take(columns: Columns, rows: np.ndarray) -> Columns:
    return {name: column[rows] for name, column in columns.items()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)],
        names=[name for name, _ in fields],
    )


_ROWS = "anchor long, context long, id long, tag long, low long, place long, span_end long"


def _row_batch(rows: Columns, spans: Columns) -> pa.RecordBatch:
    """Records, and spans (context null) under a hash of their own."""
    own_hash = _mix(spans["id"].astype(np.uint64) * np.uint64(_BASE) + spans["start"].astype(np.uint64))
    n, m = len(rows["id"]), len(spans["id"])
    spans_only, records_only = np.r_[np.zeros(n, bool), np.ones(m, bool)], np.r_[np.ones(n, bool), np.zeros(m, bool)]
    columns = [
        pa.array(np.r_[rows["anchor"], own_hash].view(np.int64)),
        pa.array(np.r_[rows["context"].view(np.int64), np.zeros(m, np.int64)], mask=spans_only),
        *[pa.array(np.r_[rows[name], spans[name]], pa.int64()) for name in KEY],
        pa.array(np.r_[_place(rows), spans["start"]], pa.int64()),
        pa.array(np.r_[np.zeros(n, np.int64), spans["end"]], pa.int64(), mask=records_only),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _ROWS.split(", ")])


def _place(rows: Columns) -> np.ndarray:
    """Anchor, bytes before it and strings owned in one number, ordered by the anchor's place."""
    return (rows["at"] << 16) | (rows["before"].astype(np.int64) << 8) | rows["owned"]


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(*document_key(), utf8().alias("utf8"))


def _reader(flush):
    """Hands the records of about FLUSH bytes of text at a time to ``flush``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        docs: list[Columns] = []
        texts: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows, named = _joined(held, _RECORD), _joined(docs, _DOCS)
            return flush({**rows, **_take(named, rows["doc"])}, named, texts)

        for batch in batches:
            keys = {name: np.array(batch.column(name).to_numpy(zero_copy_only=False)) for name in KEY}
            own = batch.column("utf8").to_pylist()
            for parts in _buffers(own):
                found = records(parts)
                held.append({**found, "doc": found["doc"] + np.uint32(len(texts))})
                size += sum(len(part) for _, _, part in parts)
            texts.extend(own)
            docs.append(keys)
            if size >= FLUSH:
                yield done()
                held.clear(), docs.clear(), texts.clear()
                size = 0
        if texts:
            yield done()

    return read


def _send_records(hot: np.ndarray):
    """Records of anchors that are not hot, one of each context; spans of local later copies."""

    def flush(rows: Columns, _: Columns, __: list[bytes]) -> pa.RecordBatch:
        rows = _take(rows, np.flatnonzero(~np.isin(rows["anchor"], hot)))
        order, first, later = _first_of_equal(["anchor", "context"], rows)
        return _row_batch(_take(rows, order[first]), _merged(_covered(_take(rows, order[later]))))

    return _reader(flush)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _decide(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and context: spans of later copies, contexts to be compared.

    Whole anchors are decided once about ``most`` rows are held; only a larger anchor holds more.
    """
    for part in _whole_anchors(batches, most):
        yield from _decided(part)


def _whole_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor in parts that end with the last row of an anchor."""
    held: list[pa.RecordBatch] = []
    size, due = 0, most
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= due:
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor = rows["anchor"].to_numpy()
            whole = int(np.argmax(anchor == anchor[-1]))  # the last one may go on
            if whole:
                yield rows.slice(0, whole)
            held = rows.slice(whole).to_batches()
            size = len(rows) - whole
            # An anchor beyond the bound is joined anew only when it has doubled.
            due = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _decided(table: pa.Table) -> Iterator[pa.RecordBatch]:
    is_span = table["context"].is_null().to_numpy()
    columns = {name: table[name].fill_null(0).to_numpy() for name in table.column_names}
    given, rows = _take(columns, is_span), _take(columns, ~is_span)
    spans = [{**{name: given[name] for name in KEY}, "start": given["place"], "end": given["span_end"]}]
    rows = {
        "anchor": rows["anchor"],
        "context": rows["context"],
        **{name: rows[name] for name in KEY},
        "at": rows["place"] >> 16,
        "before": rows["place"] >> 8 & 255,
        "owned": rows["place"] & 255,
    }
    first, later = _groups(["anchor", "context"], rows)
    spans.append(_covered(_take(rows, later)))

    compared = _take(rows, first)  # one of each context, by anchor
    same = compared["anchor"][1:] == compared["anchor"][:-1]
    if len(compared["anchor"]):
        compared = _take(compared, np.r_[False, same] | np.r_[same, False])
    yield from _marks(_merged(_joined(spans, _SPAN)), None).to_batches()
    yield from _marks(None, compared).to_batches()


_MARKS = "id long, tag long, low long, spans array<long>, anchors array<long>, places array<long>"


def _marks(spans: Columns | None, contexts: Columns | None) -> pa.Table:
    """Rows by document with its spans, or its contexts as anchor and packed place."""
    rows = spans if contexts is None else contexts
    order = np.lexsort([rows[name] for name in KEY[::-1]])
    named = {name: rows[name][order] for name in KEY}
    at = np.flatnonzero(_new_docs(named))
    bounds = np.r_[at, len(order)]
    none = pa.ListArray.from_arrays(np.zeros(len(at) + 1, np.int32), pa.array([], pa.int64()))
    if contexts is None:
        flat = np.stack([rows["start"][order], rows["end"][order]], axis=1).ravel()
        lists = [_lists(2 * bounds, flat), none, none]
    else:
        lists = [none, _lists(bounds, rows["anchor"][order]), _lists(bounds, _place(rows)[order])]
    columns = [*[pa.array(named[name][at], pa.int64()) for name in KEY], *lists]
    return pa.table(columns, names=[*KEY, "spans", "anchors", "places"])


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(values, pa.int64()))


# --- step 2: transforms of the contexts a task holds ------------------------------------------

_SHARDS = "bucket long, n int, n_docs int, n_suffixes int, contexts binary, docs binary, bwt binary"
_SUFFIX = {"place": "<u4", "symbol": "<u8"}


def n_words(contexts: Columns) -> np.ndarray:
    """Words of each context, counted from the anchor; the outer ones may be partly filled."""
    before = contexts["before"].astype(np.int64)
    after = contexts["owned"].astype(np.int64) - 1 + LENGTH - before
    return -(-before // WORD) + -(-after // WORD)


def _aligned(context: bytes, before: int) -> bytes:
    """Filled up with zeros so that the anchor starts at a word."""
    left, right = -before % WORD, -(len(context) - before) % WORD
    return bytes(left) + context + bytes(right)


def transform(words: np.ndarray, sizes: np.ndarray) -> Columns:
    """Suffixes in order with the symbol before each (0 before a whole string).

    String i has ``sizes[i]`` of the words and an end of its own, which sorts before all words and
    the ends of later strings. Places count words and ends.
    """
    n, strings = len(words) + len(sizes), len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    symbol = np.zeros(n, np.uint64)
    symbol[~is_end] = words
    rank = np.empty(n, np.int64)
    rank[ends] = np.arange(strings)
    rank[~is_end] = strings + np.unique(words, return_inverse=True)[1]
    own_end = np.repeat(ends, sizes + 1)
    step = 1
    while step <= sizes.max(initial=0):
        ahead = rank[np.minimum(np.arange(n) + step, own_end)]
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        step *= 2
    place = np.argsort(rank, kind="stable")
    before = np.where(_string_starts(place, sizes), 0, symbol[place - 1])
    return {"place": place.astype(np.uint32), "symbol": before.astype(np.uint64)}


def _string_starts(place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.zeros(len(place) + 1, bool)
    starts[np.cumsum(sizes + 1) - sizes - 1] = True
    return starts[place]


def _send_shards(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        contexts: list[Columns] = []
        words: list[bytes] = []
        docs: list[tuple[int, ...]] = []
        size = 0
        for batch in batches:
            for *key, text, anchors, places in zip(*(c.to_pylist() for c in batch.columns)):
                place = np.array(places, np.int64)
                own = {
                    "anchor": np.array(anchors, np.int64).view(np.uint64),
                    "doc": np.full(len(place), len(docs), np.uint32),
                    "at": place >> 16,
                    "before": (place >> 8 & 255).astype(np.uint8),
                    "owned": (place & 255).astype(np.uint8),
                }
                docs.append(tuple(key))
                contexts.append(own)
                text = unpack(text)
                for at, before, owned in zip(*(own[c].tolist() for c in ("at", "before", "owned"))):
                    start = at - before
                    words.append(_aligned(text[start : start + owned - 1 + LENGTH], before))
                    size += len(words[-1])
            if size >= FLUSH:
                yield _shard_batch(contexts, words, docs, buckets)
                contexts, words, docs, size = [], [], [], 0
        if docs:
            yield _shard_batch(contexts, words, docs, buckets)

    return send


def _shard_batch(contexts, words, docs, buckets: int) -> pa.RecordBatch:
    rows = _joined(contexts, _CONTEXT)
    named = dict(zip(KEY, np.array(docs, np.int64).reshape(-1, len(KEY)).T.copy()))
    bucket = _bucket_of(rows["anchor"], buckets)
    out = []
    for number in np.unique(bucket).tolist():
        chosen = np.flatnonzero(bucket == number)
        own = _take(rows, chosen)
        text = b"".join(words[i] for i in chosen.tolist())
        shard = transform(np.frombuffer(text, ">u8").astype(np.uint64), n_words(own))
        listed, own["doc"] = np.unique(own["doc"], return_inverse=True)
        out.append(
            (
                number,
                len(chosen),
                len(listed),
                len(shard["place"]),
                _packed(own, _CONTEXT),
                _packed(_take(named, listed), _DOCS),
                _packed(shard, _SUFFIX),
            )
        )
    return _batch(_SHARDS, out)


# --- step 3: merge of transforms --------------------------------------------------------------


def interleave(shards: list[tuple[Columns, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the shards' suffixes by their first ``rounds`` symbols, and its prefixes.

    A shard is its transform and the sizes of its strings. Returns the suffixes as indices into
    the shards one after the other, and for each the length (at most ``rounds``) of the longest
    prefix it has in common with the one before.
    """
    lengths = np.array([len(suffixes["place"]) for suffixes, _ in shards])
    strings = np.array([len(sizes) for _, sizes in shards])
    offsets = np.cumsum(lengths) - lengths
    n, ends = int(lengths.sum()), int(strings.sum())
    shard_of = np.repeat(np.arange(len(shards)), lengths)
    whole = np.concatenate([_string_starts(s["place"], sizes) for s, sizes in shards])
    symbol = np.concatenate([s["symbol"] for s, _ in shards])
    symbol = np.unique(symbol, return_inverse=True)[1].astype(np.int32)
    # A shard's ends come first in it, so its other suffixes follow in order.
    end_slots = np.concatenate([o + np.arange(e) for o, e in zip(offsets, strings)])
    others = np.concatenate([np.arange(o + e, o + k) for o, e, k in zip(offsets, strings, lengths)])
    order = np.arange(n)
    block = np.zeros(n, np.int64)
    common = np.full(n, rounds, np.int32)
    common[: ends + 1] = 0
    for length in range(rounds):
        extended = ~whole[order]
        source, source_block = order[extended], block[extended]
        dealt = np.argsort(symbol[source], kind="stable")
        source, source_block = source[dealt], source_block[dealt]
        # The k-th suffix dealt from a shard is its k-th in its own order.
        body = np.empty(len(source), np.int64)
        body[np.argsort(shard_of[source], kind="stable")] = others
        order = np.concatenate([end_slots, body])
        parted = (symbol[source][1:] != symbol[source][:-1]) | (source_block[1:] != source_block[:-1])
        slots = ends + 1 + np.flatnonzero(parted)
        common[slots[common[slots] == rounds]] = length
        block = np.cumsum(common < rounds)
    return order, common


def _merge(table: pa.Table) -> pa.Table:
    """Spans of the strings of a bucket's contexts that also start earlier."""
    contexts, shards = [], []
    for row in table.to_pylist():
        own = _unpacked(row["contexts"], row["n"], _CONTEXT)
        contexts.append({**own, **_take(_unpacked(row["docs"], row["n_docs"], _DOCS), own["doc"])})
        shards.append((_unpacked(row["bwt"], row["n_suffixes"], _SUFFIX), n_words(own)))
    rounds = LENGTH // WORD
    order, common = interleave(shards, rounds)
    lengths = [len(suffixes["place"]) for suffixes, _ in shards]
    offsets = np.cumsum([0, *lengths[:-1]])
    place = np.concatenate([o + s["place"].astype(np.int64) for o, (s, _) in zip(offsets, shards)])
    whole = np.concatenate([_string_starts(s["place"], sizes) for s, sizes in shards])
    symbol = np.concatenate([s["symbol"] for s, _ in shards])
    words = np.zeros(len(place) + rounds + 1, np.uint64)
    words[place[~whole] - 1] = symbol[~whole]

    rows = _joined(contexts, {**_CONTEXT, **_DOCS})
    sizes = np.concatenate([s for _, s in shards])
    first_word = np.cumsum(sizes + 1) - sizes - 1
    owned, before = rows["owned"].astype(np.int64), rows["before"].astype(np.int64)
    context = np.repeat(np.arange(len(owned)), owned)
    back = before[context] - (np.arange(len(context)) - np.repeat(np.cumsum(owned) - owned, owned))
    # A string starts ``back`` bytes before its anchor, ``extra`` of them before a full word.
    extra = back % WORD
    suffix = first_word[context] + -(-before[context] // WORD) - back // WORD
    full = (LENGTH - extra) // WORD
    rest = (LENGTH - extra) % WORD
    interval = np.zeros(len(context), np.int64)
    for depth in np.unique(full).tolist():
        number = np.empty(len(place), np.int64)
        number[place[order]] = np.cumsum(common < depth)
        own = full == depth
        interval[own] = number[suffix[own]]
    several = np.flatnonzero(np.bincount(interval)[interval] > 1) if len(interval) else interval
    suffix, extra, full, rest = (x[several] for x in (suffix, extra, full, rest))
    bits = np.uint64(8 * WORD)
    left = words[suffix - 1] & ((np.uint64(1) << (8 * extra).astype(np.uint64)) - np.uint64(1))
    tail = words[suffix + full] >> np.minimum(bits - (8 * rest).astype(np.uint64), bits - np.uint64(1))
    windows = {
        "interval": interval[several],
        "back": back[several],
        "left": np.where(extra > 0, left, 0),
        "tail": np.where(rest > 0, tail, 0),
        **{name: rows[name][context[several]] for name in KEY},
        "at": rows["at"][context[several]] - back[several],
    }
    order, _, later = _first_of_equal(["interval", "back", "left", "tail"], windows)
    found = _take(windows, order[later])
    spans = {**{name: found[name] for name in KEY}, "start": found["at"], "end": found["at"] + LENGTH}
    return _marks(_merged(spans), None).select([*KEY, "spans"])


# --- hot anchors ------------------------------------------------------------------------------

_SAMPLED = 64  # one document in so many tells which anchors are hot
_DIGESTS = "first8 long, last8 long, id long, tag long, low long, at long, span_end long"


def _hot_anchors(docs: DataFrame, most: int) -> np.ndarray:
    """Anchors with more than about ``most`` different contexts.

    Only the way they are handled depends on it, not the result. Each has at least most / 64
    contexts in the sample, which bounds their number.
    """

    def flush(rows: Columns, _: Columns, __: list[bytes]) -> pa.RecordBatch:
        order, first, _ = _first_of_equal(["anchor", "context"], rows)
        anchors, many = np.unique(rows["anchor"][order[first]], return_counts=True)
        return _batch("anchor long, many long", list(zip(anchors.view(np.int64).tolist(), many.tolist())))

    sample = docs if most < _SAMPLED else docs.filter(F.pmod(F.xxhash64(*KEY), F.lit(_SAMPLED)) == 0)
    counted = sample.mapInArrow(_reader(flush), "anchor long, many long").groupBy("anchor")
    least = most if most < _SAMPLED else most // _SAMPLED
    rows = counted.agg(F.sum("many").alias("many")).filter(F.col("many") > least).collect()
    return np.array(sorted(row["anchor"] for row in rows), np.int64).view(np.uint64)


def _hot_spans(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Spans of the strings of hot anchors that also start earlier, one row per string."""

    def flush(rows: Columns, _: Columns, texts: list[bytes]) -> pa.RecordBatch:
        rows = _take(rows, np.flatnonzero(np.isin(rows["anchor"], hot)))
        first: dict[bytes, tuple] = {}
        out = []
        order = np.lexsort([rows[name] for name in [*KEY, "at"][::-1]])
        names = ("doc", *KEY, "at", "before", "owned")
        for doc, *key, at, before, owned in zip(*(rows[c][order].tolist() for c in names)):
            for start in range(at - before, at - before + owned):
                digest = hashlib.blake2b(texts[doc][start : start + LENGTH], digest_size=16).digest()
                later = first.setdefault(digest, (*key, start)) != (*key, start)
                # Local later copies are decided here; only firsts meet those of other tasks.
                halves = np.frombuffer(digest, "<i8").tolist()
                out.append((*halves, *key, start, start + LENGTH if later else 0))
        return _batch(_DIGESTS, out)

    rows = stage(docs.mapInArrow(_reader(flush), _DIGESTS), "hot-strings")
    local = rows.filter("span_end > 0").select(*KEY, F.array("at", "span_end").alias("spans"))
    firsts = rows.filter("span_end = 0").drop("span_end")
    place = F.struct(*KEY, "at")
    known = firsts.groupBy("first8", "last8").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("many"))
    later = firsts.join(known.filter("many > 1"), ["first8", "last8"]).filter(place != F.col("first"))
    return local.unionByName(
        later.select(*KEY, F.array("at", F.col("at") + LENGTH).alias("spans"))
    )


# --- the operator -----------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Byte spans to remove by document: id, tag, low, spans (start, end, start, end, ...)."""
    keyed = _with_key(docs)
    anchors = _hot_anchors(keyed, hot)
    sent = keyed.mapInArrow(_send_records(anchors), _ROWS)
    by_anchor = sent.repartition("anchor").sortWithinPartitions("anchor", "context", *KEY, "place")
    marks = stage(by_anchor.mapInArrow(_decide, _MARKS), "repeat-marks")

    contexts = marks.filter(F.size("anchors") > 0)
    many = contexts.agg(F.sum(F.size("anchors")).alias("n")).first()["n"] or 0
    listed = contexts.groupBy(*KEY).agg(
        F.collect_list(F.struct("anchors", "places")).alias("parts")
    ).select(
        *KEY,
        F.flatten(F.transform("parts", lambda p: p["anchors"])).alias("anchors"),
        F.flatten(F.transform("parts", lambda p: p["places"])).alias("places"),
    )
    held = _compressed(docs).join(listed, KEY).select(*KEY, "text", "anchors", "places")
    shards = held.mapInArrow(_send_shards(-(-many // BUCKET_CONTEXTS) or 1), _SHARDS)
    merged = shards.groupBy("bucket").applyInArrow(_merge, "id long, tag long, low long, spans array<long>")

    spans = marks.filter(F.size("spans") > 0).select(*KEY, "spans").unionByName(merged)
    if len(anchors):
        spans = spans.unionByName(_hot_spans(keyed, anchors))
    return spans.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _compressed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Texts as they travel between tasks."""

    @F.pandas_udf("binary")
    def compressed(texts):
        compress = zstandard.ZstdCompressor(level=3).compress
        return texts.map(compress)

    return docs.select(*columns, *document_key(), compressed(utf8()).alias("text"))


_CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    spans = stage(repeated_spans(docs, hot), "repeat-spans")

    @F.pandas_udf(_CUT)
    def cut(texts, spans):
        import pandas as pd

        unpack = zstandard.ZstdDecompressor().decompress
        rows = [_without(unpack(text), own) for text, own in zip(texts, spans)]
        return pd.DataFrame(rows, columns=[field.split()[0] for field in _CUT.split(", ")])

    joined = _compressed(docs, F.col("doc_id")).join(spans, KEY, "left")
    return joined.select("doc_id", cut("text", "spans").alias("_cut")).select("doc_id", "_cut.*")


def _without(text: bytes, spans) -> tuple[int, int, int, bytes]:
    kept, done, runs = [], 0, 0
    pairs = [] if spans is None else sorted(zip(spans[::2], spans[1::2]))
    for start, end in pairs:
        if start > done or runs == 0:
            runs += 1
            kept.append(text[done:start])
        done = max(done, end)
    kept.append(text[done:])
    left = b"".join(kept)
    return len(text), len(text) - len(left), runs, left
