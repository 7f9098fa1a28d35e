"""Operators on single texts, conversations and packing against plain versions."""

import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import (
    chat_format,
    decontaminate,
    language,
    packing,
    pii,
    quality,
    toxicity,
)
from tests.llm import plain

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [
    None, "", " ", "\n\n", "word", "é ß 中文 words", "a b c  d\x1ce", "don't  stop\n now ",
    "x" * 5000, "7 " * 400, "One. two!\tthree\r\nfour", "tab\tand  two  spaces\n \nend", "'s 'll re",
]


def _sentence(rng, words):
    return " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(words))


# --- quality ---


def test_quality_statistics(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["a b c d e f " * 3 + "tail\nend\nend\n\nend #|<>", "one two " * 9]
    texts += [" ".join(rng.choices("abc", k=40)) for _ in range(10)]
    df = plain.documents(spark, list(enumerate(texts)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for row in quality.quality_rules(df).collect():
        assert tuple(row[n] for n in names) == plain.quality(texts[row["doc_id"]])
        assert not (row["kept"] and row["base_failed"])
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_compression_bands(spark):
    rng = random.Random(2)
    prose = [_sentence(rng, n) for n in (12, 60, 400, 3000)]
    repeated = " ".join(f"row {i} of the very same table with the same old words in it" for i in range(300))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(200))
    mixed = prose[3][:8000] + repeated[:8000]
    texts = [*prose, repeated, noise, mixed]
    df = plain.documents(spark, list(enumerate(texts)))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    filtered = quality.keep_quality(df)
    assert filtered.columns == df.columns and filtered.count() == 4
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    ratio, _ = quality.compression(texts[3].encode(), compress)
    assert ratio == len(compress(texts[3].encode())) / len(texts[3].encode())


def test_repeated_windows_beyond_dense_codes():
    rng = random.Random(3)
    words = [str(rng.randrange(9000)).encode() for _ in range(20_000)]
    words[15_000:15_007] = words[100:107]
    assert quality.repeat_words(words) == plain.quality(" ".join(w.decode() for w in words))[4] == 14


# --- decontamination ---


def _benchmark(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, block_bytes):
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choices("abcd", k=rng.randint(1, 40)))) for i in range(12)]
    items += [("20", _sentence(rng, 30)), ("21", ""), ("22", None), ("3", _sentence(rng, 20)), (None, "zz yy")]
    docs = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 600)))) for i in range(20)]
    docs += [(i + 30, t) for i, t in enumerate(AWKWARD)]
    docs += [(60, f"Start, {items[12][1].upper()}! end"), (61, " ".join(items[15][1].split()[:13]))]
    docs += [(62, items[12][1] + " " + _sentence(rng, 900)), (63, "ZZ--yy"), (63, "ZZ--yy")]
    df = plain.documents(spark, docs)
    marked = decontaminate.with_contamination(df, _benchmark(spark, items), "kept_", block_bytes)
    named = [(name or "", text) for name, text in items]
    for row in marked.collect():
        got = row["kept_"]
        expected = plain.contamination(row["text"], named)
        assert (got["n_words"], got["n_hit"], list(got["items"]), got["contaminated"]) == expected
        assert got["n_items"] == len(expected[2])
        assert got["items_sha256"] == plain.sha(",".join(expected[2]))
    clean = decontaminate.keep_uncontaminated(df, _benchmark(spark, items))
    assert clean.columns == df.columns
    dirty = [i for i, t in docs if plain.contamination(t, named)[3]]
    assert clean.count() == len(docs) - len(dirty)


def test_contamination_of_empty_tables(spark):
    df = plain.documents(spark, [(1, "a b c")])
    none = _benchmark(spark, [])
    assert not decontaminate.contamination(df, none).first()["contaminated"]
    assert decontaminate.contamination(df.limit(0), _benchmark(spark, [("1", "a")])).count() == 0


# --- personal data ---


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    alphabet = list("aZ0159.._%+-@@.. ()\n") + ["4111 1111 1111 1111", "10.0.0.255", "+49 (30) 12", "é", "a@b.c"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        spans = [s for s in pii.candidates(text) if s.base]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in spans] == plain.base_spans(text), text


@given(st.text(alphabet="a1@.-_+ ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_spans_property(text):
    assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.base_spans(text)] == plain.base_spans(text)


def test_personal_data_of_documents(spark):
    rng = random.Random(6)
    texts = [f"{_sentence(rng, 8)} mail me at ab{i}@mail.example.com or {_sentence(rng, 4)}" for i in range(40)]
    texts += [f"{_sentence(rng, 5)} api_key = {rng.getrandbits(120):x} {_sentence(rng, 5)}" for i in range(40)]
    texts += [f"login password={rng.getrandbits(60):x}A{i}" for i in range(20)] + AWKWARD
    df = plain.documents(spark, list(enumerate(texts)))
    rows = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    for i, text in enumerate(texts):
        base = plain.base_spans(text)
        assert rows[i]["base_sha256"] == plain.sha(",".join(base))
        assert set(base) <= set(rows[i]["spans"].split(",")) or not base
        assert rows[i]["n_email"] == sum(s.startswith("email") for s in base)
    assert sum(rows[i]["n_added"] for i in range(40, 100)) == 60
    assert sum(rows[i]["n_added"] for i in range(100, len(texts))) == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(none).count() == 0


def test_long_runs_take_linear_time():
    text = "a" * 200_000 + " " + "1." * 100_000 + " " + "+1" + " " * 100_000 + "@" * 1000
    assert pii.base_spans(text) is not None


def test_reliabilities_tell_good_votes_from_bad():
    counts = {("secret", "0,1,1,1,0"): 500, ("secret", "0,0,-1,-1,0"): 500, ("secret", "0,1,0,1,0"): 300}
    chance = pii.reliabilities(counts)
    assert chance["secret", "0,1,0,1,0"] > 0.9 > 0.1 > chance["secret", "0,0,-1,-1,0"]


# --- toxicity ---


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(7)

    def text(kind):
        words = [_sentence(rng, 1) for _ in range(rng.randint(5, 60))]
        # Either word alone is harmless, both together are not.
        words += {"a": ["glorp"], "b": ["zumpers"], "ab": ["glorp", "zumpers"], "": []}[kind]
        rng.shuffle(words)
        return " ".join(words), int(kind == "ab")

    rows = [text(rng.choice(["", "a", "b", "ab"])) for _ in range(1200)]
    df = plain.documents(spark, [(i, t) for i, (t, _) in enumerate(rows)] + [(5000, None), (5001, "")])
    labels = spark.createDataFrame(
        [(i, 1, toxic) for i, (_, toxic) in enumerate(rows)] + [(7000, 1, 1), (1, 1, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = toxicity.score_toxicity(df, labels).collect()
    assert len(found) == len(rows) + 2
    held = [r for r in found if r["held_out"] and r["doc_id"] < 5000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    right = [r["predicted"] == rows[r["doc_id"]][1] for r in held]
    assert len(held) > 150 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_toxicity_without_labels(spark):
    df = plain.documents(spark, [(1, "a"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(df, none).collect()] == [0.0, 0.0]


def test_margin_counts_every_pair_once():
    rng = np.random.default_rng(0)
    factor = rng.normal(size=(4, 3))
    machine = toxicity.Machine(0.5, np.zeros(1), np.arange(4.0), factor)
    pairs = sum(factor[i] @ factor[j] for i in range(3) for j in range(i))
    assert np.isclose(machine.margin(np.arange(3)), 0.5 + 0 + 1 + 2 + pairs)


# --- language ---


def test_languages(spark):
    rng = random.Random(8)
    sounds = {"en": "the ing wh th sh", "de": "sch ung ch ei der", "fr": "eau oi que les ai", "es": "ción os la ue rr"}
    docs = []
    for i in range(600):
        lang = rng.choice(list(sounds))
        word = lambda: "".join(rng.choices(sounds[lang].split(), k=rng.randint(1, 3)))
        docs.append((i, " ".join(word() for _ in range(rng.randint(3, 80))), lang))
    docs += [(1000, None, "en"), (1001, "12 ?! …", "fr"), (1002, "schung " * 50, None), (1003, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    right = [rows[i]["lang_pred"] == lang for i, _, lang in docs[:600] if rows[i]["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert [rows[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "de", "und"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_languages_with_nothing_to_learn(spark):
    rows = [(1, "hello", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify_languages(df).collect()] == ["und", "und"]
    one = spark.createDataFrame([(1, "hello there", "en"), (3, "bonjour", None)], df.schema)
    assert {r["lang_pred"] for r in language.identify_languages(one).collect()} == {"en"}


def test_margins_of_many_texts_equal_those_of_one():
    rng = random.Random(9)
    texts = [_sentence(rng, n).encode() for n in (1, 5, 50)] + [b"", b"a"]
    texts.append(_sentence(rng, 400_000).encode())  # longer than a slice
    x = np.random.default_rng(0).random((8, language.BUCKETS)).astype(np.float32)
    model = language.fit(x, ["en", "de", "fr", "es"] * 2)
    together = language.margins(model, texts)
    for text, row in zip(texts, together):
        assert np.allclose(language.margins(model, [text])[0], row)
        codes = language.trigram_codes(language.fold(text)) if text else []
        mean = model.weights[codes].mean(axis=0, dtype=np.float64) if len(codes) else 0
        assert np.allclose(mean + model.bias, row)


# --- chat formatting ---

CONTROLS = "<|turn|> <|text|> <|more|> <|end|> </s> <s> [INST] [/INST] <\\| \\ <| <\\\\|x <".split(" ")


def test_chats_read_back(spark):
    rng = random.Random(10)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            text = "".join(rng.choices([*CONTROLS, "word", " ", "\n", "é", "🙂"], k=rng.randint(0, 8)))
            role = rng.choice(["user", "assistant", "assistant", "<|end|>", "system"])
            rows.append((conv, turn, role, text))
    rows += [(50, t, "assistant" if t % 3 else "user", f"turn {t}") for t in range(700)]
    rows += [(51, None, None, None), (51, 1, "assistant", None), (51, 1, "assistant", None), (51, 1, "user", "b")]
    rows += [(None, 0, "user", "a"), (None, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("formatted", F.lit(1)).withColumn("block", F.lit(2)).repartition(5)
    formatted = chat_format.format_chats(df)
    expected: dict = {}
    for conv, turn, role, text in sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    ):
        expected.setdefault(conv, []).append((role or "", text or ""))
    found = {r["conv_id"]: r for r in chat_format.chat_digests(formatted).collect()}
    assert found.keys() == expected.keys()
    for conv, turns in expected.items():
        learned = "".join(text for role, text in turns if role == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == plain.sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), plain.sha(learned))
    for row in formatted.collect():
        assert row["formatted"].count("<|turn|>") == sum(
            1 for at, (role, _) in enumerate(expected[row["conv_id"]])
            if at == 0 or expected[row["conv_id"]][at - 1][0] != role
        )
    assert chat_format.chat_digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.chat_digests(chat_format.format_chats(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapIn", plan)


# --- packing ---


def _whole_ids(texts):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(TOKENIZER)
    loaded.encode_special_tokens = True
    return [e.ids for e in loaded.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_those_of_whole_texts():
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "a", "Word", "don't", "'s", "42", "é", "中", " ", "\x1c", " ", "!?", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [t for t in AWKWARD if t]
    packed = packing.token_ids(texts, TOKENIZER)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == _whole_ids(texts)


def test_ids_of_all_characters_equal_those_of_the_tokenizer():
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b 1{c}2 {c} {c}{c}. {c}'s  {c}" for c in known[:0x3200] + known[0x3200::7]]
    packed = packing.token_ids(texts, TOKENIZER)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == _whole_ids(texts)


def test_other_tokenizers_are_used_as_they_are(tmp_path):
    given = Path(TOKENIZER).read_text("utf-8")
    assert len(packing.byte_ranks(given)) == 50_256
    swapped = json.loads(given)
    swapped["model"]["merges"][5], swapped["model"]["merges"][6] = swapped["model"]["merges"][6:4:-1]
    spaced = json.loads(given)
    spaced["pre_tokenizer"]["add_prefix_space"] = True
    for other in (swapped, spaced):
        assert packing.byte_ranks(json.dumps(other)) is None
        path = tmp_path / "other.json"
        path.write_text(json.dumps(other), "utf-8")
        packing._encoders.pop(str(path), None)
        from tokenizers import Tokenizer

        expected = Tokenizer.from_file(str(path)).encode("some plain text", add_special_tokens=False).ids
        (got,) = packing.token_ids(["some plain text"], str(path))
        assert np.frombuffer(got, "<u4").tolist() == expected
    assert packing.byte_ranks(Path(public_tokenizers.path("word_bpe_49k.json")).read_text("utf-8")) is None


@pytest.mark.parametrize("group", [50_000, 60])
def test_every_id_is_packed_once_without_gaps(spark, group):
    rng = random.Random(12)
    texts = AWKWARD + [_sentence(rng, int(rng.expovariate(1 / 200))) for _ in range(300)]
    docs = list(enumerate(texts))
    pieces = packing.token_pieces(plain.documents(spark, docs), TOKENIZER, 0.2)
    from faultline.staging import stage

    rows = packing.pack(stage(pieces, "pieces"), group=group).collect()
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_doc) == len(docs)
    for (i, _), ids in zip(docs, _whole_ids(texts)):
        ids, at = [*ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(own), len(ids))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
        padding += packing.WINDOW - end
    if group > 1000:
        assert padding < packing.WINDOW


def test_sum_of_squares_chooses_the_smallest_growth():
    counts = np.zeros(11, np.int64)
    counts[[3, 4, 7]] = [2, 1, 1]
    # A piece of 3: level 7 completes a window, level 4 makes two at 7, level 3 frees one of two.
    squares = lambda c: int((c[:10] ** 2).sum())
    best = None
    for level in (0, 3, 4, 7):
        after = counts.copy()
        after[level] -= level > 0
        after[level + 3] += 1
        growth = squares(after) - squares(counts)
        if best is None or growth < best[0] or growth == best[0] and level:
            best = (growth, level)
    assert packing._best_level(counts, 3, 10) == best[1]


def test_packing_of_repeated_rows_nulls_and_nothing(spark):
    df = plain.documents(spark, [(1, "a b"), (1, "a b"), (None, None), (None, "c")])
    rows = packing.packed_documents(df, TOKENIZER).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.packed_documents(df.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_toxicity_learns_pairs_whose_words_tell_nothing_alone(alike):
    """Label 1 where both words stand or neither, or the other way round; each word alone is even."""
    rng = random.Random(13)

    def made(n):
        docs, kinds = [], []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            words = [_sentence(rng, 1) for _ in range(rng.randint(5, 60))] + ["glorp"] * a + ["zumpers"] * b
            rng.shuffle(words)
            docs.append(toxicity._terms(" ".join(words).encode()))
            kinds.append(float((a == b) == alike))
        return docs, np.array(kinds)

    docs, kinds = made(1800)
    machine = toxicity.fit(docs, kinds, np.ones(len(kinds)))
    assert 0 < (machine.place >= 0).sum() < 100  # and nothing of the other words
    docs, kinds = made(500)
    places = [machine.place[d] for d in docs]
    margins = np.array([machine.margin(p[p >= 0]) for p in places])
    assert ((margins > 0) == (kinds > 0)).mean() > 0.95
