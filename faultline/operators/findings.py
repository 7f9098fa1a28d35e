"""Findings from rule hits, their context, score, rank and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.lines import raw_meta
from faultline.functions.scoring import SEVERITIES, VERDICTS, actionability, severity_rank, verdict
from faultline.operators.bursts import burst_clusters, burst_settings
from faultline.operators.ordered import CHUNK_LINES, chunk_of, with_row_number
from faultline.operators.runtime_filter import likely_members
from faultline.operators.rule_hits import rule_hits
from faultline.rules import RULE_LIBRARY, Rules, as_rules, rules_table
from faultline.staging import fits_broadcast, stage

BAND_LINES = 32  # lines that meet findings under one join key


def rule_triggers(
    lines: DataFrame, rules: Rules = RULE_LIBRARY, chunk_lines: int = CHUNK_LINES
) -> DataFrame:
    """One row per rule finding, before its context is attached.

    Every hit of a single-line rule, and for a burst rule the first line of each cluster.
    """
    spark, rules = lines.sparkSession, as_rules(rules)
    hits = stage(rule_hits(lines, rules), "rule-hits")
    single = [i for i, rule in enumerate(rules) if not rule.is_burst]
    triggers = hits.filter(F.col("rule_ord").isin(single)).withColumn(
        "burst_line_numbers", F.array().cast("array<bigint>")
    )
    if len(single) < len(rules):
        bursting = hits.filter(~F.col("rule_ord").isin(single))
        clusters = burst_clusters(bursting, burst_settings(spark, rules), chunk_lines)
        opening = clusters.select(
            "file", "rule_ord", "line_no", F.col("lines").alias("burst_line_numbers")
        )
        triggers = triggers.unionByName(bursting.join(opening, ["file", "rule_ord", "line_no"]))
    meta = raw_meta(F.col("value"))
    described = triggers.join(
        F.broadcast(rules_table(spark, rules)), "rule_ord"  # one row per rule
    )
    return described.select(
        "file",
        F.col("rule_ord").alias("source_ord"),
        F.col("name").alias("rule_name"),
        "category",
        "severity",
        "description",
        F.col("line_no").alias("line_number"),
        meta["timestamp"].alias("timestamp"),
        meta["elapsed_ms"].alias("elapsed_ms"),
        meta["component"].alias("component"),
        F.col("value").alias("trigger_line"),
        "burst_line_numbers",
        F.greatest(F.lit(1), F.size("burst_line_numbers")).alias("burst_size"),
        F.lit(None).cast("double").alias("classifier_attention"),
        F.lit(False).alias("rare_template"),
        F.col("context_before").alias("n_before"),
        F.col("context_after").alias("n_after"),
    )


def attach_context(triggers: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace n_before and n_after by the arrays context_before and context_after.

    Findings and lines meet on (file, band of lines); a finding touches two or three bands.
    A band has few lines, so no key runs hot, and the lines need no window. While the
    findings' keys are small they are broadcast and the lines are only scanned. Beyond that
    both sides shuffle, but of the lines only those that may lie in a wanted band.
    """
    triggers = stage(triggers, "triggers")
    key = ["file", "source_ord", "line_number"]
    number = F.col("line_number")
    low = F.greatest(F.lit(1), number - F.col("n_before")).alias("low")
    high = (number + F.col("n_after")).alias("high")
    wanted = triggers.select(*key, low, high).withColumn(
        "band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("high"))))
    )
    line_no = F.col("line_no")
    banded = lines.select("file", "line_no", "value", _band(line_no).alias("band"))
    if fits_broadcast(wanted):
        met = banded.join(F.broadcast(wanted), ["file", "band"])
    else:
        met = likely_members(banded, wanted, ["file", "band"]).join(wanted, ["file", "band"])
    around = (
        met
        .filter((line_no != number) & line_no.between(F.col("low"), F.col("high")))
        .groupBy(*key)
        .agg(
            _ordered_text(line_no < number).alias("context_before"),
            _ordered_text(line_no > number).alias("context_after"),
        )
    )
    nothing = F.array().cast("array<string>")
    return (
        triggers.drop("n_before", "n_after")
        .join(around, key, "left")
        .withColumns(
            {name: F.coalesce(name, nothing) for name in ("context_before", "context_after")}
        )
    )


def _band(line_no: Column) -> Column:
    return F.floor(line_no / F.lit(BAND_LINES)).cast("bigint")


def _ordered_text(keep: Column) -> Column:
    part = F.when(keep, F.struct("line_no", "value"))
    return F.transform(F.array_sort(F.collect_list(part)), lambda row: row["value"])


def rule_findings(
    lines: DataFrame, rules: Rules = RULE_LIBRARY, chunk_lines: int = CHUNK_LINES
) -> DataFrame:
    """Rule findings of every file, with context, not yet ranked."""
    return attach_context(rule_triggers(lines, rules, chunk_lines), lines)


def rank_findings(findings: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Add actionability_score and the rank of each finding in its file, best first.

    Score, then severity, then line, then rule order. A file's findings are numbered
    within (score, severity, stretch of lines), so one file cannot fill a task.
    """
    scored = findings.withColumn(
        "actionability_score",
        actionability(
            F.col("severity"),
            F.col("burst_size"),
            F.col("classifier_attention"),
            F.col("rare_template"),
        ),
    )
    return with_row_number(
        scored,
        keys=["file"],
        coarse={
            "score": F.col("actionability_score"),
            "severity": severity_rank(F.col("severity")),
            "chunk": chunk_of("line_number", chunk_lines),
        },
        coarse_order=[
            F.col("_unit_score").desc(), F.col("_unit_severity").desc(), F.col("_unit_chunk")
        ],
        order=[F.col("line_number"), F.col("source_ord")],
        out="rank",
    )


def file_verdicts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict and counts of every file in ``files``, clean ones included."""
    counts = findings.groupBy("file").agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES],
    )
    zero = F.lit(0).cast("bigint")
    return (
        files.select("file")
        .join(counts, "file", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("findings", *SEVERITIES)})
        .select(
            "file",
            verdict(F.col("findings"), F.col("CRITICAL") + F.col("HIGH")).alias("verdict"),
            "findings",
            F.struct(*SEVERITIES).alias("severity"),
        )
    )


def corpus_summary(verdicts: DataFrame) -> DataFrame:
    """One row: total_files and the number of files per verdict, zeros included."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.struct(
            *[F.count_if(F.col("verdict") == name).alias(name) for name in VERDICTS]
        ).alias("verdict_counts"),
    )
