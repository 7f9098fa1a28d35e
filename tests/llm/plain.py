"""Plain, slow versions of the operators, and tables of awkward documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(spark, rows, extra: str = ""):
    """A table with doc_id and text, and columns that could clash with work columns."""
    full = [(i, t, "en", "s", 0 if t is None else len(t), "x", 1, 2.0) for i, t in rows]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "kept string, id long, tag double"
    )
    return spark.createDataFrame(full, schema)


def removed_strings(docs: list[tuple[int, str | None]], length: int = 100) -> dict:
    """For (doc_id, text) with distinct ids: n_bytes, n_removed, n_spans, digest of what is kept."""
    first: dict[bytes, tuple] = {}
    out = {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if first.setdefault(data[at : at + length], (doc_id, at)) != (doc_id, at):
                gone[at : at + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc_id] = (len(data), int(gone.sum()), runs, sha(kept))
    return out


def line_dedup(docs: list[tuple[int, str | None]], min_lines: int = 4, min_words: int = 20) -> dict:
    """For (doc_id, text) with distinct ids: what is left, n_removed and the longest run."""
    filled = {
        i: [line for line in (t or "").split("\n") if re.search(SPACE, line)] for i, t in docs
    }
    removed: dict[int, set[int]] = {i: set() for i in filled}
    longest = dict.fromkeys(filled, 0)
    size = 1
    while size <= max(map(len, filled.values()), default=0):
        places: dict[tuple, list] = {}
        for i in sorted(filled):
            for n in range(len(filled[i]) - size + 1):
                places.setdefault(tuple(filled[i][n : n + size]), []).append((i, n))
        for run, found in places.items():
            if len(found) > 1:
                words = sum(len(re.findall(SPACE, line)) for line in run)
                for i, _ in found:
                    longest[i] = max(longest[i], size)
                for i, n in found[1:]:
                    if size == min_lines or size < min_lines and words >= min_words:
                        removed[i].update(range(n, n + size))
        size *= 2
    out = {}
    for i, text in docs:
        kept, n = [], 0
        for line in (text or "").split("\n"):
            is_line = re.search(SPACE, line) is not None
            if not (is_line and n in removed[i]):
                kept.append(line)
            n += is_line
        out[i] = ("\n".join(kept), len(removed[i]), longest[i])
    return out


def simhash(text: str | None) -> int:
    words = re.findall(SPACE, lowered(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        ones = [n + (h >> bit & 1) for bit, n in enumerate(ones)]
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def groups(prints: dict[int, int], radius: int = 2) -> dict[int, int]:
    """Smallest id reachable over links of at most ``radius`` differing bits."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for at, i in enumerate(ids):
        for other in np.flatnonzero(np.bitwise_count(values[at + 1 :] ^ values[at]) <= radius):
            a, b = find(i), find(ids[at + 1 + other])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def contamination(text: str | None, items: list[tuple[str, str | None]]) -> tuple:
    """n_words, n_hit, names of the items found, contaminated."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(word, lowered(text or ""))
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(word, lowered(item or ""))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(name)
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(SPACE, line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def _luhn(text: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(re.sub(r"[^0-9]", "", text))):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str | None) -> list[str]:
    text = text or ""
    digits = lambda m: len(re.sub(r"[^0-9]", "", m[0]))
    found = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (
            "ip",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            lambda m: all(int(part) <= 255 for part in m[0].split(".")),
        ),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= digits(m) <= 19 and _luhn(m[0])),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= digits(m) <= 15),
    ]
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, form, good in found
        for m in re.finditer(form, text)
        if good(m)
    ]
