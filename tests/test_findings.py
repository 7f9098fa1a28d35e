import json

import pytest
from pyspark.sql import functions as F

from faultline.functions.scoring import actionability, has_error_hint
from faultline.operators.findings import (
    BAND_LINES,
    corpus_summary,
    file_verdicts,
    rank_findings,
    rule_findings,
)
from faultline.operators.rare import (
    first_per_text,
    known_ids,
    rare_findings,
    without_rule_lines,
)
from faultline.operators.runtime_filter import likely_members
from faultline.sinks.reports import file_stem, write_reports

LINES = "file STRING, line_no BIGINT, value STRING"
FINDING = (
    "file STRING, source_ord INT, severity STRING, line_number BIGINT, burst_size INT, "
    "classifier_attention DOUBLE, rare_template BOOLEAN"
)


@pytest.mark.parametrize(
    ("severity", "burst", "classifier", "rare", "score"),
    [
        ("CRITICAL", 1, None, False, 1.00),
        ("CRITICAL", 9, None, False, 1.00),
        ("HIGH", 1, None, False, 0.75),
        ("HIGH", 5, None, False, 0.83),
        ("HIGH", 30, None, False, 0.90),
        ("MEDIUM", 1, None, True, 0.55),
        ("LOW", 1, 0.5, False, 0.30),
        ("OTHER", 1, None, False, 0.0),
    ],
)
def test_score(spark, severity, burst, classifier, rare, score):
    df = spark.createDataFrame(
        [(severity, burst, classifier, rare)], "s STRING, b INT, c DOUBLE, r BOOLEAN"
    )
    got = df.select(actionability(F.col("s"), F.col("b"), F.col("c"), F.col("r"))).first()[0]
    assert got == pytest.approx(score)


@pytest.mark.parametrize(
    ("text", "hint"),
    [
        ("an ERROR here", True), ("errors only", False), ("X_TIMEOUT", False),
        ("time-out: hang.", True), ("éfail", False), ("", False),
    ],
)
def test_error_hint(spark, text, hint):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(has_error_hint(F.col("t"))).first()[0] is hint


@pytest.mark.parametrize("chunk_lines", [1, 10, 1 << 18])
def test_rank(spark, chunk_lines):
    rows = [
        ("f", 9, "HIGH", 30, 1, None, False),
        ("f", 3, "HIGH", 30, 1, None, False),
        ("f", 0, "LOW", 1, 1, None, False),
        ("f", 5, "HIGH", 40, 5, None, False),
        ("f", 1, "CRITICAL", 99, 1, None, False),
        ("f", 1000, "MEDIUM", 2, 1, None, True),
        ("f", 2, "CRITICAL", 7, 9, None, False),
        ("g", 2, "LOW", 7, 1, 0.5, False),
    ]
    got = rank_findings(spark.createDataFrame(rows, FINDING), chunk_lines).orderBy("file", "rank")
    assert [(r["file"], r["rank"], r["source_ord"], r["line_number"]) for r in got.collect()] == [
        ("f", 1, 2, 7), ("f", 2, 1, 99), ("f", 3, 5, 40), ("f", 4, 3, 30), ("f", 5, 9, 30),
        ("f", 6, 1000, 2), ("f", 7, 0, 1), ("g", 1, 2, 7),
    ]


def ps(second, text, component="NET"):
    return f"[{second}] [t] [{component}] {text}"


def test_context_is_clipped_and_raw(spark):
    values = [f"raw {i}" for i in range(1, 13)]
    values[2] = ps("1.0", "kernel panic")
    values[11] = ps("2.0", "forced reboot")
    rows = [("f", i, v) for i, v in enumerate(values, 1)]
    got = rule_findings(spark.createDataFrame(rows, LINES)).orderBy("line_number").collect()
    assert [r["line_number"] for r in got] == [3, 12]
    assert got[0]["context_before"] == values[:2]
    assert got[0]["context_after"] == values[3:12]
    assert got[1]["context_before"] == values[:11]
    assert got[1]["context_after"] == []


def test_burst_finding(spark):
    values = [ps(f"{1 + i / 10:.1f}", "Trace |SSPLogger |Error: dump") for i in range(6)]
    rows = [("f", i, v) for i, v in enumerate(values, 1)]
    (got,) = rule_findings(spark.createDataFrame(rows, LINES)).collect()
    assert (got["line_number"], got["burst_size"]) == (1, 6)
    assert got["burst_line_numbers"] == [1, 2, 3, 4, 5, 6]
    assert (got["trigger_line"], got["timestamp"], got["elapsed_ms"]) == (values[0], "1.0", 1000)


ENTRIES = "file STRING, line_no BIGINT, elapsed_ms BIGINT, component STRING, message STRING"
DETECTION = [
    (5, "E0000", "open failed", "open failed"),
    (8, "E0001", "state change ok", "state change <*>"),
    (12, "E0001", "state change timeout", "state change <*>"),
    (15, "<unk>", "fatal", "fatal"),
    (18, "E0001", "state change timeout", "state change <*>"),
    (20, "E0002", "link error", "link error"),
    (30, "E0003", "panic", "panic"),
]


def detect(spark, cap):
    entries = spark.createDataFrame(
        [("f", no, 1500 + no, "NET", message) for no, _, message, _ in DETECTION], ENTRIES
    )
    resolved = spark.createDataFrame(
        [(message, event_id, t) for _, event_id, message, t in DETECTION],
        "masked STRING, event_id STRING, template STRING",
    ).distinct()
    normal = known_ids(
        spark.createDataFrame([("E0000",), ("<unk>",), ("",), (None,)], "event_id STRING")
    )
    return rare_findings(first_per_text(entries), entries, resolved, normal, cap)


def test_rare_templates(spark):
    ruled = spark.createDataFrame([("f", 20)], "file STRING, line_number BIGINT")
    capped = detect(spark, 2)
    assert [r["line_number"] for r in capped.orderBy("line_number").collect()] == [12, 20]
    (got,) = without_rule_lines(capped, ruled).collect()
    assert (got["line_number"], got["timestamp"], got["trigger_line"]) == (
        12, "1.512", "state change timeout",
    )
    assert got["description"].endswith('normal-training file: "state change <*>"')
    assert [r["line_number"] for r in detect(spark, 20).orderBy("line_number").collect()] == [
        12, 20, 30,
    ]


def test_verdicts_and_summary(spark):
    files = spark.createDataFrame([(f,) for f in "abcd"], "file STRING")
    findings = spark.createDataFrame(
        [("a", "LOW"), ("a", "HIGH"), ("b", "MEDIUM"), ("b", "LOW"), ("c", "CRITICAL")],
        "file STRING, severity STRING",
    )
    verdicts = file_verdicts(findings, files)
    got = {r["file"]: (r["verdict"], r["findings"], tuple(r["severity"])) for r in verdicts.collect()}
    assert got == {
        "a": ("ANOMALOUS", 2, (0, 1, 0, 1)),
        "b": ("SUSPICIOUS", 2, (0, 0, 1, 1)),
        "c": ("ANOMALOUS", 1, (1, 0, 0, 0)),
        "d": ("NORMAL", 0, (0, 0, 0, 0)),
    }
    total = corpus_summary(verdicts).first()
    assert (total["total_files"], tuple(total["verdict_counts"])) == (4, (2, 1, 1))


def test_reports(spark, tmp_path):
    values = [ps("1.5", 'kernel panic "quoted" \\ é'), "tail", ps("2.5", "Deauthenticated (reason 0x07)")]
    lines = spark.createDataFrame([("/l/a.b.log", i, v) for i, v in enumerate(values, 1)], LINES)
    findings = rank_findings(rule_findings(lines)).cache()
    files = spark.createDataFrame([("/l/a.b.log",), ("/l/clean.log",)], "file STRING")
    verdicts = file_verdicts(findings, files).cache()
    out = tmp_path / "out"
    for _ in range(2):  # the second run replaces the first
        write_reports(findings, verdicts, str(out))
    report = json.loads((out / "json" / "a.b.findings.json").read_text())
    assert (report["file"], report["verdict"], report["finding_count"]) == (
        "/l/a.b.log", "ANOMALOUS", 2,
    )
    assert [f["line_number"] for f in report["findings"]] == [3, 1]
    assert report["findings"][1]["trigger_line"] == values[0]
    assert report["findings"][1]["classifier_attention"] is None
    assert [p.name for p in (out / "json").iterdir() if p.suffix != ".crc"] == ["a.b.findings.json"]

    text = (out / "md" / "a.b.findings.md").read_text()
    assert text.startswith(
        "# Anomaly Report: `a.b.log`\n\n**Verdict:** `ANOMALOUS`  |  **Findings:** 2\n\n"
        "**Severity summary:** `CRITICAL`: 1  `HIGH`: 1\n\n## 1. `CRITICAL` AP sent"
    )
    assert text.endswith(f"```\n> {values[0]}\n  tail\n  {values[2]}\n```\n\n---\n\n")
    assert "Burst size" not in text

    summary = json.loads((out / "summary" / "summary.json").read_text())
    assert summary["total_files"] == 2
    assert summary["verdict_counts"] == {"ANOMALOUS": 1, "SUSPICIOUS": 0, "NORMAL": 1}
    assert [f["file"] for f in summary["files"]] == ["a.b.log", "clean.log"]
    assert spark.read.parquet(f"{out}/findings").count() == 2


def test_file_stem(spark):
    df = spark.createDataFrame([("/x/a.b.log",), ("c.log",), ("/x/.log",)], "f STRING")
    assert [r[0] for r in df.select(file_stem(F.col("f"))).collect()] == ["a.b", "c", ".log"]


def test_context_by_shuffle_join(spark, monkeypatch):
    rows = [("f", i, ps(f"{i}.0", "kernel panic" if i % 9 == 0 else "x")) for i in range(1, 80)]
    lines = spark.createDataFrame(rows, LINES)
    expected = sorted(map(str, rule_findings(lines).collect()))
    monkeypatch.setattr("faultline.operators.findings.fits_broadcast", lambda df: False)
    assert sorted(map(str, rule_findings(lines).collect())) == expected


def test_firsts_are_hash_aggregated(spark):
    entries = spark.createDataFrame([("f", 1, "fatal 1")], "file STRING, line_no BIGINT, message STRING")
    plan = first_per_text(entries)._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_only_wanted_bands_are_shuffled(spark, monkeypatch):
    """With the keys too large for a broadcast, the lines are filtered before their exchange."""
    monkeypatch.setattr("faultline.operators.findings.fits_broadcast", lambda df: False)
    wanted = {5: 4 + 10, 40_000: 15 + 10, 77_777: 15 + 10}
    number = (F.col("id") + 1).alias("line_no")
    text = F.when((F.col("id") + 1).isin(*wanted), ps("1.0", "kernel panic")).otherwise("x")
    lines = spark.range(100_000).select(F.lit("f").alias("file"), number, text.alias("value"))
    found = rule_findings(lines)
    got = {r["line_number"]: len(r["context_before"] + r["context_after"]) for r in found.collect()}
    assert got == wanted

    # The exchange of lines lies above the filter, and what passes lies in the wanted bands.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_get" in plan
    triggers = found.select("file", F.explode(F.sequence(F.col("line_number") - 15, F.col("line_number") + 10)).alias("n"))
    bands = triggers.select("file", F.floor(F.col("n") / BAND_LINES).alias("band")).distinct()
    banded = lines.withColumn("band", F.floor(F.col("line_no") / BAND_LINES))
    passed = likely_members(banded, bands, ["file", "band"])
    physical = passed.repartition("file", "band")._jdf.queryExecution().sparkPlan().toString()
    assert physical.index("Exchange") < physical.index("bit_get") < physical.index("Range")
    assert passed.count() <= bands.count() * BAND_LINES + 0.2 * 100_000


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 16])
def test_likely_members_are_all_members_and_few_others(spark, most_bits):
    rows = spark.range(200_000).select(
        F.concat(F.lit("f"), F.col("id") % 7).alias("file"), (F.col("id") * 37 % 90_001).alias("band"), "id"
    )
    keys = rows.filter("id % 97 = 3").select("file", "band")
    kept = likely_members(rows, keys, ["file", "band"], most_bits)
    assert kept.columns == rows.columns
    members = rows.join(keys.distinct(), ["file", "band"], "left_semi")
    assert members.join(kept, "id", "left_anti").count() == 0
    assert members.count() <= kept.count() < members.count() + 0.1 * 200_000
    assert likely_members(rows, keys.limit(0), ["file", "band"]).count() == 0
