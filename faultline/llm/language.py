"""Language identification in two steps: the family first, then the language inside it.

Features are hashed byte trigrams of the folded text, as shares of all its trigrams. Families are
told apart one against the rest; related languages by one linear support vector machine for each
pair, which vote. All machines are linear in the shares, so a text is scored by looking up the
weights of its trigrams and adding them up; scoring is map-only.

The fit sees at most ``PER_LANGUAGE`` documents of a language, drawn by a hash of the doc_id, each
as a whole and as one passage of ``PASSAGE`` bytes, so that short texts are learned as well.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0. With only
one language to learn, every other text is that language; without any, ``und``. Repeated rows get
equal answers; rows without a doc_id are not held out.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.texts import LOWER, remainder, slices, utf8
from faultline.staging import fits_broadcast, stage

UNKNOWN = "und"
BUCKETS = 4096
PER_LANGUAGE = 500
PASSAGE = 160
ROUNDS = 120
RATE = 0.05
DECAY = 1e-4
FOLDS, HELD_OUT = 4, 2
_SLICE = 1 << 20

# Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indic": "hi ur bn pa gu mr ne si".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY_OF = {language: family for family, own in FAMILIES.items() for language in own}

# Folds A-Z to a-z and all ASCII that is no letter to a space.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Classifier(NamedTuple):
    families: list[str]
    languages: dict[str, list[str]]  # by family
    pairs: list[tuple[str, str]]  # a positive margin votes for the first
    weights: np.ndarray  # (bucket, families then pairs)
    bias: np.ndarray


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].lower(), f"only {language}")


def fold(text: bytes) -> bytes:
    return b" " + text.translate(LOWER).translate(_FOLD) + b" "


def trigram_codes(folded: bytes) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    joined = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (joined * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _shares(folded: bytes) -> np.ndarray:
    counts = np.bincount(trigram_codes(folded), minlength=BUCKETS).astype(np.float32)
    return counts / max(1.0, counts.sum())


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Classifier | None:
    """A classifier fitted on documents with a language that are not held out."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(
        F.coalesce(remainder("doc_id", FOLDS) != HELD_OUT, F.lit(True))
    ).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    totals = stage(known.groupBy("lang").count(), "languages")
    side = F.broadcast(totals) if fits_broadcast(totals) else totals
    # The draw by hash leaves little more than the bound for a language, before rows are ranked.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.join(side, "lang").filter(
        draw * F.col("count") < F.lit(per_language + 5 * per_language**0.5)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))

    @F.pandas_udf("array<binary>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([_training_rows(text) for text in texts])

    rows = (
        drawn.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= per_language)
        .select("lang", "_rank", features(utf8()).alias("features"))
        .collect()
    )
    rows.sort(key=lambda row: (row["lang"], row["_rank"]))
    if not rows:
        return None
    x = np.array([np.frombuffer(f, np.float32) for row in rows for f in row["features"]])
    return fit(x, [row["lang"] for row in rows for _ in row["features"]])


def _training_rows(text: bytes) -> list[bytes]:
    folded = fold(text)
    at = len(folded) // 3
    return [_shares(part).tobytes() for part in (folded, folded[at : at + PASSAGE]) if len(part) > 2]


def fit(x: np.ndarray, languages: list[str]) -> Classifier:
    label = np.array(languages)
    by_family: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        by_family.setdefault(family_of(language), []).append(language)
    families = sorted(by_family)
    pairs = [p for f in families for p in combinations(by_family[f], 2)]
    scale = 1 / (x.std(axis=0) + 1e-4)
    x = x * scale
    family = np.array([family_of(language) for language in languages])
    machines = [_support_vectors(x, family == f) for f in families]
    for first, second in pairs:
        own = (label == first) | (label == second)
        machines.append(_support_vectors(x[own], label[own] == first))
    return Classifier(
        families,
        by_family,
        pairs,
        np.stack([w * scale for w, _ in machines], axis=1).astype(np.float32),
        np.array([b for _, b in machines]),
    )


def _support_vectors(x: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge loss with both classes at equal weight, minimised by Adam."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    if positive.all() or not positive.any():
        return np.zeros(x.shape[1]), float(y[0])
    weight = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum()).astype(np.float32)
    param = np.zeros(x.shape[1] + 1)
    mean, square = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, ROUNDS + 1):
        slack = np.maximum(0, 1 - y * (x @ param[:-1].astype(np.float32) + param[-1]))
        pull = -2 * slack * y * weight
        grad = np.append(pull @ x + DECAY * param[:-1], pull.sum())
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad**2 - square)
        move = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        param -= RATE / x.shape[1] ** 0.5 * move
    return param[:-1], float(param[-1])


def margins(model: Classifier, texts: list[bytes]) -> np.ndarray:
    """Margins of all machines for each text, (text, machine)."""
    sums, counts = np.zeros((len(texts), len(model.bias))), np.zeros(len(texts))
    owners, parts = [], []
    for number, text in enumerate(texts):
        folded = fold(text)
        # Parts of a long text overlap by two bytes, so each trigram is in one of them.
        for at in range(0, max(1, len(folded) - 2), _SLICE):
            owners.append(number)
            parts.append(folded[at : at + _SLICE + 2])
    for lo, hi in slices(parts, _SLICE):
        codes = trigram_codes(b"".join(parts[lo:hi]) + b"  ")
        ends = np.cumsum([len(part) for part in parts[lo:hi]])
        starts = ends - [len(part) for part in parts[lo:hi]]
        so_far = np.zeros((len(codes) + 1, len(model.bias)))
        np.cumsum(model.weights[codes], axis=0, out=so_far[1:])
        # The two trigrams at a part's end that reach into the next one are left out.
        last = np.maximum(ends - 2, starts)
        np.add.at(sums, owners[lo:hi], so_far[last] - so_far[starts])
        np.add.at(counts, owners[lo:hi], last - starts)
    return sums / np.maximum(1, counts)[:, None] + model.bias


def decide(model: Classifier, margin: np.ndarray) -> tuple[str, float]:
    own = margin[: len(model.families)]
    chance = np.exp(own - own.max())
    chance /= chance.sum()
    best = int(np.argmax(own))
    inside = model.languages[model.families[best]]
    votes = dict.fromkeys(inside, 0.0)
    sure = {language: [1.0] for language in inside}
    for (first, second), m in zip(model.pairs, margin[len(model.families) :]):
        if first in votes:
            votes[first if m >= 0 else second] += 1
            p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
            sure[first].append(p)
            sure[second].append(1 - p)
    winner = max(inside, key=lambda language: (votes[language], min(sure[language])))
    return winner, float(chance[best] * min(sure[winner]))


def has_letter(text: bytes) -> bool:
    if text.translate(LOWER).translate(None, bytes(set(range(256)) - set(range(97, 123)))):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def language(text: Column, model: Classifier | None, spark) -> Column:
    """Struct (lang_pred, score) for a column of UTF-8 bytes."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model, texts = sent.value, list(texts)
        if model is None:
            rows = [(UNKNOWN, 0.0)] * len(texts)
        else:
            rows = [
                decide(model, margin) if has_letter(text) else (UNKNOWN, 0.0)
                for text, margin in zip(texts, margins(model, texts))
            ]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predicted(text)


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs)
    return docs.select(
        "doc_id",
        F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        language(utf8(), model, docs.sparkSession).alias("_language"),
    ).select("doc_id", "held_out", "_language.*")
