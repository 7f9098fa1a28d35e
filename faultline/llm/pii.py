"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Exact patterns give the base spans (e-mail, address, card, phone), which always stay. Looser
patterns give candidates of these and further kinds. Five labelers (pattern, gazetteer, cue words
before and after, shape, checksum) each vote for, against or not at all on every candidate, base
spans included. There are few different vote patterns, so Spark counts them over all documents and
expectation-maximisation runs on the counts: it estimates each labeler's reliability per kind and
the chance that a vote pattern marks personal data. A logistic classifier of hashed span and
neighbour features learns these chances from at most ``SAMPLE`` different candidates, those whose
neighbourhoods have the smallest hash, each weighted by its copies, and then decides on every
candidate that does not overlap a base span.

Documents are read twice, map-only each time; only vote counts and the sample leave the tasks.

Defined cases: null and empty texts have no spans; offsets are code points of the whole text, end
exclusive; of overlapping additional spans the first by (start, kind) stays; a secret ends where its
value ends, and one that overlaps base spans is a candidate in the parts beside them; repeated rows
get equal answers. Without any candidate nothing is learned and only base spans are returned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from faultline.staging import stage

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("ssn", "iban", "secret", "name")
KINDS = BASE_KINDS + EXTRA_KINDS
LABELERS = 5
SAMPLE = 20_000
FEATURES = 4096
ROUNDS = 40
NEARBY = 48  # characters that count as the neighbourhood of a span
ACCEPT = 0.5

# Fixed forms of the base spans. Each is written so that a failing start is never tried twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser forms, for candidates only.
_LOOSE = {
    "email": re.compile(
        r"(?<![\w.+-])[\w.+-]{1,64} ?[(\[]at[)\]] ?[\w-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[\w-]{1,63}){1,4}", re.I
    ),
    "phone": re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(
        r"(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[\w/+.=-]{4,}+"
        r"|(?<!\w)(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}+",
        re.I,
    ),
    "name": re.compile(
        r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"
    ),
}
_SECRET_HINTS = ("passw", "pwd", "secret", "token", "api", "akia", "asia", "ghp_", "sk-", "xox")
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\b")
_DIGIT = re.compile(r"[0-9]")

# Gazetteers: what real values of a kind start or end with, and given names.
_GAZETTEER = {
    "email": (".com", ".org", ".net", ".edu", ".gov", ".de", ".fr", ".es", ".uk", ".io"),
    "secret": ("akia", "asia", "ghp_", "sk-", "xox", "password", "passwd", "secret", "token", "api"),
    "iban": tuple("at be ch de dk es fi fr gb ie it lu nl no pl pt se".split()),
    "name": tuple(
        "james mary john anna peter paul maria jose juan luis carlos hans klaus jürgen pierre jean "
        "marie claire david sarah laura thomas michael robert linda".split()
    ),
}
_CUES = {
    "email": "mail email e-mail contact write reach correo courriel".split(),
    "ip": "ip host server address from client login".split(),
    "card": "card visa mastercard credit payment karte tarjeta carte".split(),
    "phone": "phone call tel telephone mobile fax dial telefon teléfono".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban account bank konto compte cuenta".split(),
    "secret": "key credential login auth access password token".split(),
    "name": "name dear sincerely by from".split(),
}
_AGAINST = frozenset(
    "version isbn page figure table order item sha commit build chapter section row line".split()
)
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def base_spans(text: str) -> list[Span]:
    spans = list(_emails(text))
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(_at_most_255(part) for part in match[0].split(".")):
                spans.append(Span("ip", *match.span(), True))
        for match in _CARD.finditer(text):
            if _luhn(match[0]):
                spans.append(Span("card", *match.span(), True))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 8 <= _digits(match[0]) <= 15:
                    spans.append(Span("phone", *match.span(), True))
    return spans


def _emails(text: str) -> Iterator[Span]:
    """From each @: the local part goes back as far as it can, the domain forward."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield Span("email", start, domain.end(), True)
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> int:
    return sum(c.isascii() and c.isdigit() for c in text)


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [d if at % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for at, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def candidates(text: str) -> list[Span]:
    """Base spans, and loose ones that overlap none of them, secrets in their parts beside them."""
    spans = base_spans(text)
    lowered = text.lower()
    digits = _DIGIT.search(text) is not None
    wanted = {
        "email": "(at)" in lowered or "[at]" in lowered,
        "phone": digits,
        "ssn": digits,
        "iban": digits,
        "secret": any(hint in lowered for hint in _SECRET_HINTS),
        "name": _TITLE.search(text) is not None,
    }
    loose = [
        Span(kind, *match.span(), False)
        for kind, form in _LOOSE.items()
        if wanted[kind]
        for match in form.finditer(text)
    ]
    base = _Base(sorted((s.start, s.end) for s in spans))
    taken: list[tuple[int, int]] = []  # accepted loose spans, none of which overlap
    for found in sorted(loose, key=lambda s: (s.start, s.kind)):
        for span in _beside(text, found, base) if found.kind == "secret" else [found]:
            at = bisect_left(taken, (span.end, -1))
            beside_loose = at == 0 or taken[at - 1][1] <= span.start
            if beside_loose and not base.overlapping(span):
                spans.append(span)
                insort(taken, (span.start, span.end))
    return spans


class _Base:
    """Base spans by start, which may overlap each other, and how far each and those before reach."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = spans
        self.reach = list(accumulate((end for _, end in spans), max))

    def overlapping(self, span: Span) -> list[tuple[int, int]]:
        first = bisect_right(self.reach, span.start)
        last = bisect_left(self.spans, (span.end, -1))
        return [s for s in self.spans[first:last] if s[1] > span.start]


def _beside(text: str, secret: Span, base: _Base) -> Iterator[Span]:
    """The parts of a secret between base spans: the first if it has the form, others by length."""
    inner = base.overlapping(secret)
    if not inner:
        yield secret
        return
    head = _LOOSE["secret"].match(text, secret.start, max(secret.start, inner[0][0]))
    if head:
        yield Span("secret", *head.span(), False)
    done = inner[0][1]
    for start, end in [*inner[1:], (secret.end, secret.end)]:
        if start - done >= 4:
            yield Span("secret", done, start, False)
        done = max(done, end)


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote each, 1 for, -1 against, 0 none: pattern, gazetteer, context, shape, checksum."""
    value = text[span.start : span.end]
    lowered = value.lower()
    own = _GAZETTEER.get(span.kind, ())
    if span.kind == "email":
        listed = lowered.endswith(own)
    elif span.kind == "name":
        listed = any(word in own for word in lowered.split()[1:])
    else:
        listed = lowered.startswith(own) if own else False
    near = _neighbours(text, span)
    cue = any(word in near for word in _CUES[span.kind])
    against = not near.isdisjoint(_AGAINST)
    digits, letters = _digits(value), sum(c.isalpha() for c in value)
    shape = {
        "email": letters >= 5,
        "ip": 4 <= digits <= 12,
        "card": digits >= 16,
        "phone": 8 <= digits <= 15,
        "ssn": digits == 9,
        "iban": digits >= 10,
        "secret": digits >= 2 and letters >= 4,
        "name": digits == 0 and len(set(lowered)) > 4,
    }[span.kind]
    return (
        1 if span.base or span.kind in ("ssn", "iban") else 0,
        int(listed),
        1 if cue else -1 if against else 0,
        1 if shape else -1,
        _checksum(span.kind, value),
    )


def _neighbours(text: str, span: Span) -> set[str]:
    around = text[max(0, span.start - NEARBY) : span.start] + " " + text[span.end : span.end + NEARBY]
    return {word.lower() for word in _WORD.findall(around)}


def _checksum(kind: str, value: str) -> int:
    if kind == "card":
        return 1 if _luhn(value) else -1
    if kind == "ip":
        return 1 if all(_at_most_255(part) for part in value.split(".")) else -1
    if kind == "ssn":
        area, group, serial = value.split("-")
        return -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    if kind == "iban":
        plain = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    return 0


def features(text: str, span: Span) -> list[int]:
    """Hashed features of the value's shape and the words next to it."""
    value = text[span.start : span.end]
    shape = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", value)))
    parts = [f"length {min(20, len(value) // 3)}", f"base {span.base}"]
    parts += [f"shape {part}" for part in {shape[i : i + 3] for i in range(len(shape))}]
    parts += [f"near {word}" for word in _neighbours(text, span) if any(word in c for c in _CUES.values())]
    parts += [f"vote {n} {v}" for n, v in enumerate(votes(text, span))]
    return sorted({crc32(f"{span.kind} {part}".encode()) % FEATURES for part in parts})


_CANDIDATES = "kind string, votes string, mark long, features array<int>"


def vote_rows(docs: DataFrame) -> DataFrame:
    """One narrow row per candidate of all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                for span in candidates(text):
                    near = text[max(0, span.start - NEARBY) : span.end + NEARBY]
                    digest = hashlib.blake2b(near.encode("utf-8", "replace"), digest_size=7).digest()
                    out[0].append(span.kind)
                    out[1].append(",".join(map(str, votes(text, span))))
                    out[2].append(int.from_bytes(digest, "big"))
                    out[3].append(features(text, span))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)],
                names=[field.split()[0] for field in _CANDIDATES.split(", ")],
            )

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''")
    return texts.mapInArrow(rows, _CANDIDATES)


def reliabilities(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Chance that each (kind, vote pattern) is personal data, by EM over the counted patterns.

    Per kind the model has a share of true spans and, for each labeler, how often it votes each
    way on true and on false ones. It starts from the balance of votes.
    """
    chance: dict[tuple[str, str], float] = {}
    for kind in sorted({kind for kind, _ in counts}):
        patterns = sorted(p for k, p in counts if k == kind)
        vote = np.array([[int(v) for v in p.split(",")] for p in patterns]) + 1
        many = np.array([counts[kind, p] for p in patterns], np.float64)
        true = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1)))
        for _ in range(ROUNDS):
            share = ((many * true).sum() + 1) / (many.sum() + 2)
            log = np.log([share, 1 - share])[:, None] + np.zeros((2, len(patterns)))
            for side, weight in enumerate((many * true, many * (1 - true))):
                for labeler in range(vote.shape[1]):
                    # A vote for is taken to be likelier on true spans: a prior count each.
                    prior = np.array([0.5, 1.0, 2.0]) if side == 0 else np.array([2.0, 1.0, 0.5])
                    seen = np.bincount(vote[:, labeler], weight, minlength=3) + prior
                    log[side] += np.log(seen / seen.sum())[vote[:, labeler]]
            true = 1 / (1 + np.exp(np.clip(log[1] - log[0], -40, 40)))
        chance.update({(kind, p): float(t) for p, t in zip(patterns, true)})
    return chance


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the span classifier, the last one its bias; None without candidates."""
    rows = stage(vote_rows(docs), "candidates")
    # Copies of a passage are one neighbourhood, so the draw is among different ones.
    several = rows.groupBy("mark", "kind", "votes").agg(F.count(F.lit(1)).alias("many"))
    # At most 3 ** LABELERS patterns for each kind.
    counted = several.groupBy("kind", "votes")
    counted = counted.agg(F.sum("many").alias("many"), F.count(F.lit(1)).alias("different")).collect()
    if not counted:
        return None
    chance = reliabilities({(r["kind"], r["votes"]): r["many"] for r in counted})
    drawn = _drawn(rows, sample, sum(r["different"] for r in counted))
    many = np.array([r["many"] for r in drawn], np.float64)
    many /= many.sum()
    owners = np.repeat(np.arange(len(drawn)), [len(r["features"]) for r in drawn])
    places = np.concatenate([r["features"] for r in drawn]).astype(np.int64)
    target = np.array([chance[r["kind"], r["votes"]] for r in drawn])
    weights = np.zeros(FEATURES + 1)
    speed = np.zeros(FEATURES + 1) + 1e-8
    for _ in range(150):
        margin = np.bincount(owners, weights[places], minlength=len(drawn)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target) * many
        grad = np.append(np.bincount(places, error[owners], minlength=FEATURES), error.sum())
        grad += 1e-5 * weights
        speed += grad**2
        weights -= 0.3 * grad / np.sqrt(speed)
    return weights


def _drawn(rows: DataFrame, sample: int, different: int) -> list[Row]:
    """The ``sample`` different candidates with the smallest marks, and how many there are of each."""
    named = ["mark", "kind", "votes", "features"]
    # Marks are even over 56 bits; the draw leaves little more than the bound to be ordered.
    share = (sample + 5 * sample**0.5) / different
    while True:
        below = rows.filter(F.col("mark") < int(share * (1 << 56))) if share < 1 else rows
        drawn = below.groupBy(named).agg(F.count(F.lit(1)).alias("many")).orderBy(named).limit(sample).collect()
        if share >= 1 or len(drawn) >= sample:
            return drawn
        share *= 4  # several candidates may share a mark, so the draw can come up short


def find_spans(text: str, weights: np.ndarray | None) -> list[Span]:
    """Base spans, and the candidates that the classifier accepts, by kind and start."""
    kept = [
        span
        for span in candidates(text)
        if span.base
        or weights is not None
        and weights[features(text, span)].sum() + weights[-1] >= np.log(ACCEPT / (1 - ACCEPT))
    ]
    return sorted(kept, key=lambda s: (KINDS.index(s.kind), s.start))


_FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_added long"
)


def personal_data(text: Column, weights: np.ndarray | None) -> Column:
    """Struct of base counts and digest, and all spans as kind:start:end."""

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_digest(find_spans(text or "", weights)) for text in texts],
            columns=[field.split()[0] for field in _FOUND.split(", ")],
        )

    return found(text)


def _digest(spans: list[Span]) -> tuple:
    def listed(some: list[Span]) -> str:
        return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in some)

    base = [s for s in spans if s.base]
    counts = [sum(s.kind == kind for s in base) for kind in BASE_KINDS]
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return *counts, digest, listed(spans), len(spans) - len(base)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, base_sha256, spans, n_added."""
    weights = train(docs)
    return docs.select(
        "doc_id", personal_data(F.col("text").cast("string"), weights).alias("_pii")
    ).select("doc_id", "_pii.*")
