"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms, hashed to ``BUCKETS``: its words, and the pieces of ``PIECES``
bytes in them, since insults are inflected and compounded. The machine adds a weight for each term
and, for each pair of terms, the product of their factor vectors, so a pair can count for more (or
less) than its two words do alone. The pairs are never listed: half of the squared sum of the
vectors less the sum of their squares is the same number.

The fit sees at most ``SAMPLE_PER_CLASS`` labelled documents of each class, those with the smallest
hash of their doc_id, weighted back to the share of their class among all labelled documents. The
machine has at most ``TERMS`` terms: those that tell the classes apart beyond chance, alone or, for
the ``PAIR_TERMS`` most frequent ones, together with another term (a pair whose joint frequencies tell
more than its two terms do alone). So a term that is as frequent in both classes takes part if it
says something in company. Scoring is map-only; the machine is of fixed size.

Defined cases: a null or empty text has no terms and scores the base rate; a document with several
labels is toxic if one says so; null labels and labels without a document are ignored; without any
labels every score is 0; documents without a doc_id are scored and count as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.texts import folded_words, remainder, utf8

BUCKETS = 1 << 18
SAMPLE_PER_CLASS = 2000
TERMS = 2048  # the machine's size
PAIR_TERMS = 2048  # terms among which pairs are looked for
PAIR_SUPPORT = 8  # documents that have a term of a pair, and that lack it
_PAIR_ROWS = 256
PIECES = (5, 6, 7)
FACTORS = 8
STEPS = 2500
BATCH = 256
RATE = 0.02
DECAY = 1e-4
FOLDS, HELD_OUT = 5, 0
_MEMO = 300_000


class Machine(NamedTuple):
    base: float
    place: np.ndarray  # by bucket: the term's number, or -1
    weight: np.ndarray
    factor: np.ndarray  # (term, factor)

    def margin(self, terms: np.ndarray) -> float:
        vectors = self.factor[terms]
        pairs = (vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)).sum() / 2
        return float(self.base + self.weight[terms].sum() + pairs)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(remainder(column, FOLDS) == HELD_OUT, F.lit(False))


def buckets_of(word: bytes) -> set[int]:
    """Buckets of a word and of its pieces; the word's ends are marked."""
    marked = b"<" + word + b">"
    terms = {marked}
    for size in PIECES:
        terms.update(marked[at : at + size] for at in range(len(marked) - size + 1))
    return {crc32(term) & (BUCKETS - 1) for term in terms}


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine | None:
    """A machine fitted on labelled documents that are not held out; None without any."""
    known = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .filter(~held_out())
    )
    totals = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    chosen = None
    for kind in sorted(totals):
        # The draw by hash leaves little more than the bound to be ordered.
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        part = known.filter(
            (F.col("toxic") == kind) & (draw * totals[kind] < per_class + 5 * per_class**0.5)
        )
        part = part.orderBy(draw, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return None

    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([_terms(text).tobytes() for text in texts])

    # At most 2 * per_class narrow rows, so sending them to the documents is bounded.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("toxic", buckets(utf8()).alias("terms"))
        .collect()
    )
    # Equal documents would count their accidental words over and over.
    rows = sorted({(row["toxic"], bytes(row["terms"])) for row in rows})
    if not rows:
        return None
    sampled = pd.Series([kind for kind, _ in rows]).value_counts()
    share = {kind: totals[kind] / sampled[kind] for kind in sampled.index}
    return fit(
        [np.frombuffer(terms, np.int32) for _, terms in rows],
        np.array([kind for kind, _ in rows], np.float64),
        np.array([share[kind] for kind, _ in rows]),
    )


def _terms(text: bytes) -> np.ndarray:
    return np.array(sorted(set().union(*map(buckets_of, set(folded_words(text))))), np.int32)


def fit(documents: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> Machine:
    """Minimise weighted logistic loss by Adam over shuffled batches."""
    terms = _telling_terms(documents, toxic)
    place = np.full(BUCKETS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    x = np.zeros((len(documents), len(terms)), np.float32)
    for row, own in enumerate(documents):
        own = place[own]
        x[row, own[own >= 0]] = 1
    weight = weight / weight.mean()
    rate = np.clip(np.average(toxic, weights=weight), 1e-3, 1 - 1e-3)
    random = np.random.default_rng(0)
    params = [
        np.array([np.log(rate / (1 - rate))]),
        np.zeros(len(terms)),
        random.normal(0, 0.01, (len(terms), FACTORS)),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        part = random.integers(0, len(documents), BATCH)
        for param, grad, (mean, square) in zip(
            params, _gradients(params, x[part], toxic[part], weight[part]), moments
        ):
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad**2 - square)
            param -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    base, linear, factor = params
    return Machine(float(base[0]), place, linear, factor)


def _telling_terms(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Terms that tell the classes apart beyond chance, alone or with another term; at most TERMS."""
    seen = np.zeros((2, BUCKETS))
    for terms, kind in zip(documents, toxic.astype(int)):
        seen[kind, terms] += 1
    many = np.array([(toxic == kind).sum() for kind in (0, 1)], float)
    ratio = _ratio([(seen[0], seen[1]), (many[0] - seen[0], many[1] - seen[1])], many)
    candidates = max(2, np.count_nonzero(seen.sum(axis=0)))
    gain = np.where(ratio > np.log(candidates), ratio, 0)
    for terms, own in _telling_pairs(documents, toxic, seen, many, ratio):
        gain[terms] = np.maximum(gain[terms], own)
    best = np.argsort(-gain, kind="stable")[:TERMS]
    return np.sort(best[gain[best] > 0])


def _ratio(cells: list[tuple[np.ndarray, np.ndarray]], many: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of what the cells (documents in them by class) tell of the class."""
    told = sum(_x_log_x(a) + _x_log_x(b) - _x_log_x(a + b) for a, b in cells)
    return 2 * (told - _x_log_x(many).sum() + _x_log_x(many.sum()))


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1))


def _telling_pairs(
    documents: list[np.ndarray], toxic: np.ndarray, seen: np.ndarray, many: np.ndarray, ratio: np.ndarray
) -> Iterator[tuple[np.ndarray, float]]:
    """Terms of the pairs that tell more together than both do alone, and how much more.

    Looked for among the PAIR_TERMS most frequent terms. Terms of the same documents, like the
    pieces of one word, count as one and come together.
    """
    draw = np.random.default_rng(1).integers(1, 1 << 63, len(documents), dtype=np.uint64)
    mark = np.zeros(BUCKETS, np.uint64)  # equal for terms of the same documents
    for terms, own in zip(documents, draw):
        mark[terms] += own
    total = seen.sum(axis=0)
    known = np.flatnonzero((total >= PAIR_SUPPORT) & (total <= many.sum() - PAIR_SUPPORT))
    members = known[np.unique(mark[known], return_index=True)[1]]
    members = np.sort(members[np.argsort(-total[members], kind="stable")[:PAIR_TERMS]])
    if len(members) < 2:
        return
    place = np.full(BUCKETS, -1, np.int64)
    place[members] = np.arange(len(members))
    x = np.zeros((len(documents), len(members)), np.float32)
    for row, terms in enumerate(documents):
        at = place[terms]
        x[row, at[at >= 0]] = 1
    chance = 2 * np.log(len(members) ** 2 / 2)
    for lo in range(0, len(members), _PAIR_ROWS):
        own = members[lo : lo + _PAIR_ROWS]
        cells: list[list[np.ndarray]] = [[], [], [], []]
        for kind in (0, 1):
            part = x[toxic == kind]
            both = (part[:, lo : lo + _PAIR_ROWS].T @ part).astype(float)
            one, other = seen[kind, own][:, None], seen[kind, members][None, :]
            for cell, value in zip(cells, (both, one - both, other - both, many[kind] - one - other + both)):
                cell.append(value)
        more = _ratio([(a, b) for a, b in cells], many) - ratio[own][:, None] - ratio[members][None, :]
        i, j = np.nonzero(more > chance)
        for a, b in zip(i[lo + i < j], j[lo + i < j]):
            alike = np.isin(mark[known], mark[[own[a], members[b]]])
            yield known[alike], float(more[a, b])


def _gradients(params, x, toxic, weight):
    base, linear, factor = params
    sums = x @ factor
    margin = base[0] + x @ linear + (sums**2 - x @ factor**2).sum(axis=1) / 2
    error = (_sigmoid(margin) - toxic) * weight / len(toxic)
    by_term = error @ x
    return (
        np.array([error.sum()]),
        by_term + DECAY * linear,
        x.T @ (error[:, None] * sums) - by_term[:, None] * factor + DECAY * factor,
    )


def _sigmoid(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def toxicity(text: Column, machine: Machine | None, spark) -> Column:
    """Score between 0 and 1 of a column of UTF-8 bytes."""
    sent = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = sent.value
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        memo: dict[bytes, frozenset[int]] = {}
        margins = np.empty(len(texts))
        for at, text in enumerate(texts):
            if len(memo) > _MEMO:
                memo.clear()
            found: set[int] = set()
            for word in set(folded_words(text)):
                own = memo.get(word)
                if own is None:
                    numbers = {int(model.place[bucket]) for bucket in buckets_of(word)}
                    own = memo[word] = frozenset(numbers - {-1})
                found |= own
            margins[at] = model.margin(np.array(sorted(found), np.int64))
        return pd.Series(_sigmoid(margins))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = train(docs, labels)
    scored = docs.select(
        "doc_id",
        held_out().alias("held_out"),
        toxicity(utf8(), machine, docs.sparkSession).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
