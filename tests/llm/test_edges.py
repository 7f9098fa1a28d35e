"""All operators on awkward tables: nulls, very long texts, repeated rows, ties, clashing columns, no rows.

Columns whose names an operator might use for its own work, and the order of the rows, change nothing.
Repeated rows get equal results, and no row is lost.
"""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultline.llm import (
    decontaminate,
    divergence,
    fingerprints,
    language,
    line_dedup,
    packing,
    periodic_runs,
    pii,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "id tag low _docs _cut _fp fp _utf8 spans anchors rank n words w h g a p item value term count "
    "print near key turned chunk head tail kept removed score predicted toxic items starts _chosen_id "
    "lang_pred held_out component_id root runs collapsed ids start length _group part"
).split()


def _rows():
    rng = random.Random(21)

    def prose(n):
        return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(n))

    long = prose(30_000)
    shared = prose(60)
    rows = [
        (1, None, None, None), (2, "", "en", ""), (3, " \n\t\n ", "en", "s"), (4, "word", None, "s"),
        (None, "no id " + shared, "de", None), (None, "no id " + shared, "de", None), (None, None, None, None),
        (5, long, "en", "s"), (6, "x" * 200_000, "de", "t"), (7, "a b " * 20_000, "en", "t"),
        (8, shared, "en", "s"), (8, shared, "en", "s"), (9, shared + " tail", "en", "s"),
        (8, "another text of the same id", "en", "s"), (10, "mail a.b@c.de or 10.0.0.1, token=abcDEF123456", "en", "t"),
    ]
    rows += [(100 + i, f"{prose(12)}\n{shared if i % 7 == 0 else ''}", rng.choice(["en", "de"]), rng.choice("st")) for i in range(40)]
    return [(*row, len(row[1] or "")) for row in rows]


ROWS = _rows()
LABELS = [(doc_id, 1, i % 2) for i, (doc_id, *_) in enumerate(ROWS)] + [(5, None, None), (None, 1, 1), (77_777, 0, 1)]
ITEMS = [("i1", ROWS[10][1]), ("i1", ROWS[10][1]), (None, "word"), ("i3", None), ("i4", "")]


def _labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def _items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")


# Whether a row comes back per document, and the operator.
OPERATORS = {
    "suffix_dedup": (True, lambda spark, d: suffix_dedup.remove_repeats(d)),
    "toxicity": (True, lambda spark, d: toxicity.score_toxicity(d, _labels(spark))),
    "decontaminate": (True, lambda spark, d: decontaminate.contamination(d, _items(spark))),
    "pii": (True, lambda spark, d: pii.find_personal_data(d)),
    "line_dedup": (True, lambda spark, d: line_dedup.line_report(d)),
    "quality": (True, lambda spark, d: quality.quality_rules(d)),
    "language": (True, lambda spark, d: language.identify_languages(d)),
    "simhash": (True, lambda spark, d: simhash.simhash_groups(d)),
    "packing": (False, lambda spark, d: packing.packed_documents(d, TOKENIZER).drop("sequence_id", "offset")),
    "fingerprints": (True, lambda spark, d: fingerprints.fingerprint_report(d)),
    "periodic_runs": (True, lambda spark, d: periodic_runs.periodic_runs(periodic_runs.with_planted_runs(d))),
    "divergence": (False, lambda spark, d: divergence.source_divergence(d, 5, 10)),
}
STAGES = {
    "quality": lambda spark, d: quality.keep_quality(d),
    "line_dedup": lambda spark, d: line_dedup.dedup_lines(d),
    "simhash": lambda spark, d: simhash.keep_first(d),
    "decontaminate": lambda spark, d: decontaminate.keep_uncontaminated(d, _items(spark)),
}


def _plain(df):
    return Counter(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_rows_and_clashing_columns(spark, name):
    per_document, operator = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, DOCS)
    found = operator(spark, docs)
    rows = _plain(found)
    if per_document:
        assert sum(rows.values()) == len(ROWS)
        ids = Counter(r["doc_id"] for r in found.select("doc_id").collect())
        assert ids == Counter(row[0] for row in ROWS)
    if name == "packing":  # cut pieces depend on the room that is left, ids do not
        return
    clashing = docs.select("*", *[F.lit(f"{i}").alias(c) for i, c in enumerate(CLASHING)])
    again = _plain(operator(spark, clashing.repartition(5)))
    if name in ("toxicity", "language", "pii"):  # fits sum in the order of the rows
        assert sum(again.values()) == sum(rows.values())
    else:
        assert again == rows


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_documents(spark, name):
    assert OPERATORS[name][1](spark, spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_all_columns(spark, name):
    clashing = [c for c in CLASHING if c not in DOCS]
    docs = spark.createDataFrame(ROWS, DOCS).select("*", *[F.lit(f"{i}").alias(c) for i, c in enumerate(clashing)])
    kept = STAGES[name](spark, docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert 0 < len(rows) <= len(ROWS)
    assert all(r[c] == str(i) for r in rows for i, c in enumerate(clashing))
    assert STAGES[name](spark, docs.limit(0)).count() == 0
