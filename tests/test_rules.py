"""The numbers and texts of the rule library, written out once more by hand."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions.scoring import HINT_WORDS, SEVERITIES, VERDICTS
from faultline.operators.findings import rule_findings
from faultline.operators.many_rules import required_texts
from faultline.operators.rule_hits import matches, rule_hits
from faultline.rules import RULE_LIBRARY, Rule, as_rules

# Severity, burst size and window in seconds, context lines before and after.
EXPECTED = {
    "use_after_free_timer": ("CRITICAL", None, None, 8, 8),
    "deauth_reason_07_class3_frame": ("CRITICAL", None, None, 10, 10),
    "deauth_reason_0f_cipher_mismatch": ("CRITICAL", None, None, 10, 10),
    "deauth_unexpected_reason": ("HIGH", None, None, 10, 10),
    "firmware_diagnostic_error": ("CRITICAL", None, None, 5, 15),
    "firmware_error_burst": ("CRITICAL", 5, 2.0, 3, 20),
    "association_rejected_with_status": ("HIGH", None, None, 8, 4),
    "background_scan_failed": ("HIGH", None, None, 5, 5),
    "tx_queue_overflow_storm": ("HIGH", 10, 5.0, 4, 4),
    "watchdog_or_hard_reset": ("HIGH", None, None, 15, 10),
}


def test_numbers_of_the_rules():
    found = {
        r.name: (r.severity, r.burst_min, r.burst_window_s, r.context_before, r.context_after)
        for r in RULE_LIBRARY
    }
    assert found == EXPECTED
    assert [r.name for r in RULE_LIBRARY] == list(EXPECTED)


def test_words_and_levels():
    assert SEVERITIES == ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    assert VERDICTS == ("ANOMALOUS", "SUSPICIOUS", "NORMAL")
    assert sorted(HINT_WORDS) == (
        "abort corrupt denied error exception fail failed failure fatal hang invalid leak overflow "
        "panic reject stuck timeout underflow"
    ).split()


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        ("kernel panic", ["kernel panic"]),
        (r"Deauth\s*\(reason\s*0x0?7\)", ["(reason"]),
        (r"(one|two) (three|four)?", ["one", "two"]),
        (r"(alpha|beta x) (gamma|d)", ["alpha", "beta x"]),
        (r"\p{Nd}+ lost (?<what>link|port)", [" lost "]),
        (r"(?:abcd)+|(?:wxyz){2,}", ["abcd", "wxyz"]),
        (r"(?:abcd)*xy", []),
        (r"a.*b", []),
        (r"[a-c[x]]yzw", []),
        (r"\Qa.b\E", []),
        (r"(?x) a b c d", []),
        ("über alles", ["ber alles"]),
        (r"x\vyzw", ["yzw"]),
        ("(unclosed", []),
        ("", []),
    ],
)
def test_required_texts(pattern, texts):
    assert list(required_texts(pattern)) == texts


def _many(rng, n):
    rules = []
    for i in range(n):
        word = "".join(rng.choices("akis", k=3)) + str(rng.randrange(20))
        pattern = rng.choice([
            word, f"{word}\\b.*(up|down)", f"(?:{word}|x{word}) now", f"{word[:2]}.{word[2]}", rf"\bid {i % 9}\d\b",
            rf"\p{{L}}+ {word}", "k[aı]s",
        ])
        rules.append(Rule(f"r{i:03}", "c", "HIGH", pattern, "d", rng.choice([None, "down", r"\d{3}"])))
    return rules


def _text(rng):
    words = ["".join(rng.choices("akisKſıİK", k=3)) + str(rng.randrange(20)) for _ in range(6)]
    return f"[1.5] [t] [c] {' '.join(words)} id {rng.randrange(99)} {rng.choice(['up', 'down', 'now', 'AKI7 now'])}"


def test_three_hundred_rules_equal_one_rlike_each(spark):
    rng = random.Random(1)
    rules = _many(rng, 300)
    rows = [("f", i, _text(rng)) for i in range(400)] + [("f", 400, "no log line aki7"), ("f", 401, None), ("f", 402, "")]
    lines = spark.createDataFrame(rows, "file STRING, line_no BIGINT, value STRING").repartition(4)
    got = sorted((r["line_no"], r["rule_ord"]) for r in rule_hits(lines, rules).collect())
    expected = []
    whole = lines.filter("value like '[%'").cache()
    for start in range(0, 300, 50):
        fired = [F.when(matches(r, F.col("value")), start + i) for i, r in enumerate(rules[start : start + 50])]
        for row in whole.select("line_no", F.array_compact(F.array(*fired)).alias("o")).collect():
            expected += [(row["line_no"], o) for o in row["o"]]
    assert got == sorted(expected) and len(got) > 500


def test_rules_as_rows(spark):
    table = rule_table(spark).filter("burst_min is null").drop("burst_min", "burst_window_s")
    assert as_rules(table) == tuple(r._replace(literals=()) for r in RULE_LIBRARY if not r.is_burst)
    lines = spark.createDataFrame(
        [("f", 1, "[1.0] [t] [c] kernel panic"), ("f", 2, "[1.0] [t] [c] fine")], "file STRING, line_no BIGINT, value STRING"
    )
    few = spark.createDataFrame(
        [("b", "cat", "LOW", "FINE", "text"), ("a", "cat", "HIGH", "panic$", "text")],
        "name STRING, category STRING, severity STRING, pattern STRING, description STRING",
    )
    found = [(r["line_number"], r["rule_name"], len(r["context_after"])) for r in rule_findings(lines, few).collect()]
    assert sorted(found) == [(1, "a", 1), (2, "b", 0)]


def rule_table(spark):
    from faultline.rules import rules_table

    return rules_table(spark)


def test_too_many_rules_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("faultline.rules.MAX_RULES", 3)
    with pytest.raises(ValueError, match="more than 3 rules"):
        as_rules(rule_table(spark))
