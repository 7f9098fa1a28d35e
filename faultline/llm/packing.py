"""Packing of token sequences by the online sum-of-squares rule.

A document's ids are cut into full windows and one remainder. Remainders are placed one after the
other: each goes to the fill level (or a new window) for which the sum of the squared numbers of
partly filled windows per level grows least. The numbers live in one array with a place for each
level. Tokenising is map-only; only the narrow rows of the pieces are dealt out, by hash, to groups
of about ``GROUP`` pieces, each packed by one task with an array of its own. Windows that are still
open at a group's end are poured together where they fit. A small share of the documents is held
back as fillers: their last pieces, with their ids, are cut to exactly the room that is left.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as documents of
their own, and pieces without a doc_id as well. Within a group, pieces come in the order of
(doc_id, start, length, checksum), nulls last. No documents give no rows.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.texts import slices
from faultline.staging import stage

WINDOW = 1024
END_ID = 0
GROUP = 50_000
_GROUP_BITS = 24  # places for windows within a group's sequence numbers

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_CHARS_AT_A_TIME = 2 << 20
# How a byte-level tokenizer with its standard rule cuts texts into words.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def token_ids(texts: list[str], tokenizer: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, without an end id.

    A text cannot hold control tokens; their strings are ordinary text.
    """
    if tokenizer not in _encoders:
        _encoders[tokenizer] = _encoder(tokenizer)
    return _encoders[tokenizer](texts)


def _encoder(tokenizer: str) -> Callable[[list[str]], list[bytes]]:
    ranks = byte_ranks(Path(tokenizer).read_text("utf-8"))
    if ranks is not None:
        import tiktoken

        encode = tiktoken.Encoding(
            tokenizer, pat_str=_RULE, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        return lambda texts: [array("I", encode(text)).tobytes() for text in texts]

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    loaded.encode_special_tokens = True

    def encoded(texts: list[str]) -> list[bytes]:
        batch = loaded.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in batch]

    return encoded


def byte_ranks(definition: str) -> dict[bytes, int] | None:
    """The tokens of a byte-level BPE tokenizer as bytes, with their ids.

    Merging the pair with the lowest id first is what the tokenizer does if ids rise with its
    merges, and it cuts by the standard rule; this gives its ids in half the time. None for any
    other tokenizer.
    """
    given = json.loads(definition)
    model, cut = given["model"], given["pre_tokenizer"] or {}
    standard = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = all(
        not model.get(option)
        for option in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    if model.get("type", "BPE") != "BPE" or not plain or given["normalizer"] is not None:
        return None
    if any(cut.get(key) != value for key, value in standard.items()):
        return None
    vocabulary = model["vocab"]
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    ids = [vocabulary[left + right] for left, right in merges]
    single = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    # Bytes stand for the characters of the same number, or for those from 256 on, in order.
    others = (byte for byte in range(256) if byte not in single)
    byte_of = {chr(byte): byte for byte in single} | {chr(256 + n): byte for n, byte in enumerate(others)}
    control = {token["content"] for token in given["added_tokens"]}
    tokens = {token: number for token, number in vocabulary.items() if token not in control}
    alphabet = [vocabulary.get(character, -1) for character in byte_of]
    rising = all(a < b for a, b in zip(ids, ids[1:])) and min(alphabet) >= 0 and max(alphabet) < ids[0]
    if not rising or len(tokens) != 256 + len(ids) or not all(set(token) <= byte_of.keys() for token in tokens):
        return None
    return {bytes(map(byte_of.__getitem__, token)): number for token, number in tokens.items()}


def token_pieces(
    docs: DataFrame, tokenizer: str, fillers: float = 0.0, window: int = WINDOW
) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens, ids.

    The end id counts. ``ids`` (little-endian unsigned 32-bit) are kept for the last pieces of
    about the share ``fillers`` of the documents, drawn by a checksum of theirs, and for all pieces
    if it is 1; else they are null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, _CHARS_AT_A_TIME):
                rows = []
                for doc_id, ids in zip(doc_ids[lo:hi], token_ids(texts[lo:hi], tokenizer)):
                    ids += END_ID.to_bytes(4, "little")
                    tokens = len(ids) // 4
                    drawn = crc32(f"{doc_id} {crc32(ids)}".encode()) < fillers * (1 << 32)
                    for start in range(0, tokens, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        kept = drawn and (fillers >= 1 or len(piece) < 4 * window)
                        rows.append(
                            (doc_id, start, len(piece) // 4, crc32(piece), tokens, piece if kept else None)
                        )
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, _PIECES
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    names = [field.split()[0] for field in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names
    )


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence_id and offset; those with ids may come back as several.

    ``pieces`` are read twice, so they should be a written table.
    """
    groups = -(-pieces.count() // group) or 1
    dealt = pieces.withColumn(
        "_group", F.pmod(F.xxhash64(*pieces.columns), F.lit(groups)).cast("long")
    )
    order = [(name, "ascending") for name in pieces.columns]

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        filler = pc.and_(pc.is_valid(table["ids"]), pc.less(table["length"], window))
        rows = table.filter(pc.invert(filler)).drop_columns("_group")
        sequence, offset, fills = sum_of_squares(rows["length"].to_pylist(), window)
        added = fill_gaps(table.filter(filler).drop_columns("_group").to_pylist(), fills, window)
        placed = rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64())
        )
        placed = pa.concat_tables([placed, pa.Table.from_pylist(added, placed.schema)])
        first = table["_group"][0].as_py() << _GROUP_BITS
        at = placed.column_names.index("sequence_id")
        return placed.set_column(at, "sequence_id", pc.add(placed["sequence_id"], first))

    return dealt.groupBy("_group").applyInArrow(
        place, f"{_PIECES}, sequence_id long, offset long"
    )


def fill_gaps(fillers: list[dict], fills: list[int], window: int) -> list[dict]:
    """Cut fillers to the room that the windows have left, the fullest first, then to new ones."""
    open_windows = sorted((n for n, fill in enumerate(fills) if 0 < fill < window), key=lambda n: fills[n])
    added = []
    for piece in fillers:
        done = 0
        while done < piece["length"]:
            if not open_windows:
                open_windows.append(len(fills))
                fills.append(0)
            number = open_windows[-1]
            length = min(window - fills[number], piece["length"] - done)
            ids = piece["ids"][4 * done : 4 * (done + length)]
            added.append(
                piece
                | {"start": piece["start"] + done, "length": length, "ids": ids, "ids_crc32": crc32(ids)}
                | {"sequence_id": number, "offset": fills[number]}
            )
            done += length
            fills[number] += length
            if fills[number] == window:
                open_windows.pop()
    return added


def sum_of_squares(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """The window of each piece and its offset there, and how full each window is in the end."""
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    counts = np.zeros(window + 1, np.int64)  # partly filled windows by fill level
    sequence, offset, fills = [], [], []
    for length in lengths:
        level = _best_level(counts, length, window) if length < window else 0
        if level:
            number = open_at[level].pop()
            counts[level] -= 1
        else:
            number = len(fills)
            fills.append(0)
        sequence.append(number)
        offset.append(level)
        fills[number] = level + length
        if level + length < window:
            open_at[level + length].append(number)
            counts[level + length] += 1
    return _pour_together(sequence, offset, fills, window)


def _best_level(counts: np.ndarray, length: int, window: int) -> int:
    """The level whose use makes the sum of squares grow least; the fullest of equal ones."""
    levels = np.flatnonzero(counts[: window - length + 1])
    after = levels + length
    growth = np.where(after < window, 2 * counts[after] + 1, 0) - 2 * counts[levels] + 1
    fresh = 2 * counts[length] + 1
    if not len(levels) or growth.min() > fresh:
        return 0
    return int(levels[len(growth) - 1 - np.argmin(growth[::-1])])


def _pour_together(
    sequence: list[int], offset: list[int], fills: list[int], window: int
) -> tuple[list[int], list[int], list[int]]:
    """Join open windows, the fullest first, each into the fullest one that has room."""
    order = sorted((n for n, fill in enumerate(fills) if fill < window), key=lambda n: -fills[n])
    into, moved = list(range(len(fills))), [0] * len(fills)
    joined = list(fills)
    homes: list[int] = []
    for number in order:
        room = [n for n in homes if joined[n] + fills[number] <= window]
        if room:
            home = max(room, key=joined.__getitem__)
            into[number], moved[number] = home, joined[home]
            joined[home] += fills[number]
            joined[number] = 0
        else:
            homes.append(number)
    return [into[s] for s in sequence], [o + moved[s] for o, s in zip(offset, sequence)], joined


def filler_share(documents: int, group: int = GROUP) -> float:
    """Enough for the room that is left in the end, which grows with the root of the pieces."""
    return min(0.25, max(0.02, 4 / max(1, min(documents, group)) ** 0.5))


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Where each piece of each document goes, with a checksum of its ids instead of them."""
    pieces = stage(token_pieces(docs, tokenizer, filler_share(docs.count())), "pieces")
    return pack(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
