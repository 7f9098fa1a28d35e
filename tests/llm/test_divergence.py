"""The source divergence audit against plain sums over the whole vocabulary."""

import random
import re
from collections import Counter, defaultdict

import pytest

from faultline.llm import divergence
from faultline.llm.divergence import source_divergence
from tests.llm.plain import lowered

DOCS = "doc_id long, text string, lang string, source string, item string, value long, rank int, term string"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow(rows, least, top):
    texts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = WORD.findall(lowered(text or ""))
        groups[lang].add(source)
        texts[lang, source].update(words)
        documents[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        whole = sum((texts[lang, s] for s in sources), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(texts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if texts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top}
    return out


def _rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "élan", "a", "zeta", "Ünder", "x_y", "n0de", "日本", "\u0080"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "", None, "ß", "S1"])
        text = " ".join(rng.choices(words, k=rng.randrange(12))) + rng.choice(["", ".", "'s", "-"])
        rows.append((rng.randrange(5), rng.choice([text, text, None]), rng.choice(["en", "de", None, "solo"]), source))
    return rows + [(1, "once", "rare", "a"), (2, "twice", "rare", "b"), (3, "alone", "single", "a")]


def _found(spark, rows, *args):
    df = spark.createDataFrame([(*row, "i", 1, 2, "t") for row in rows], DOCS).repartition(5)
    found = source_divergence(df, *args)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, held, cells, part", [(1, 400_000, 1 << 21, 1 << 22), (2, 1, 8, 16), (3, 5, 30, 1 << 22)])
def test_equals_plain_sums(spark, monkeypatch, seed, held, cells, part):
    monkeypatch.setattr(divergence, "_HELD_TERMS", held)
    monkeypatch.setattr(divergence, "_CELLS", cells)
    monkeypatch.setattr(divergence, "_PART_BYTES", part)
    rows = _rows(seed, 300)
    rows += rows[:20]  # repeated rows are documents too
    rows.append((9, "the word " * 5000 + "élan", "en", "s9"))
    assert _found(spark, rows, 10, 4) == slow(rows, 10, 4)


def test_languages_without_kept_terms_and_no_documents(spark):
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "de", "x")]
    assert _found(spark, rows) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, weight = 3 * 10**15, 7 * 10**15 + 1
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(weight))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // weight


def test_equal_counts_are_one_entry(spark):
    """A thousand terms with the same counts cost one entry, and no row per pair and term."""
    text = " ".join("w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(1000))
    rows = [(i, text, "en", f"s{i % 3}") for i in range(30)] + [(31, "wa " * 9, "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    terms = divergence.kept_terms(df, 30)
    assert terms.count() == 1000 and terms.groupBy("counts").count().count() == 2
    assert {tuple(r) for r in source_divergence(df).collect()} == slow(rows, 30, 50)
