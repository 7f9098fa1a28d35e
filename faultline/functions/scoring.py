"""Severity, score, error-hint and verdict expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity levels in rank order, the hint words and the score weights.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
VERDICTS = ("ANOMALOUS", "SUSPICIOUS", "NORMAL")
HINT_WORDS = (
    "error", "fail", "failure", "failed", "exception", "abort", "panic", "fatal", "stuck",
    "hang", "corrupt", "invalid", "denied", "reject", "overflow", "underflow", "leak", "timeout",
)
BURST_STEP, BURST_CAP = 0.02, 0.15
CLASSIFIER_WEIGHT, RARE_BONUS = 0.10, 0.05

_WORD_BREAK_BEFORE = r"(?<![\p{L}\p{N}_])"
_WORD_BREAK_AFTER = r"(?![\p{L}\p{N}_])"
HINT = rf"(?iu){_WORD_BREAK_BEFORE}(?:{'|'.join(HINT_WORDS)}){_WORD_BREAK_AFTER}"


def has_error_hint(text: Column) -> Column:
    """True if the text holds one of the hint words as a whole word, in any case."""
    return text.rlike(HINT)


def severity_rank(severity: Column) -> Column:
    """4 for CRITICAL down to 1 for LOW; 0 for anything else."""
    rank = F.lit(0)
    for position, name in enumerate(reversed(SEVERITIES), start=1):
        rank = F.when(severity == name, F.lit(position)).otherwise(rank)
    return rank


def actionability(
    severity: Column, burst_size: Column, classifier_attention: Column, rare: Column
) -> Column:
    """Score in 0..1 that orders the findings of a file."""
    burst = F.least(F.lit(BURST_CAP), (burst_size - 1) * F.lit(BURST_STEP))
    classifier = F.coalesce(classifier_attention, F.lit(0.0)) * F.lit(CLASSIFIER_WEIGHT)
    novelty = F.when(rare, F.lit(RARE_BONUS)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), severity_rank(severity) / F.lit(4.0) + burst + classifier + novelty)


def verdict(findings: Column, serious: Column) -> Column:
    """Verdict of a file from its number of findings and of CRITICAL or HIGH ones."""
    return (
        F.when(serious > 0, F.lit("ANOMALOUS"))
        .when(findings > 0, F.lit("SUSPICIOUS"))
        .otherwise(F.lit("NORMAL"))
    )
