"""Rule predicates over raw lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.lines import is_ps_line, ps_elapsed_ms
from faultline.operators.many_rules import with_candidates
from faultline.rules import RULE_LIBRARY, Rule, Rules, as_rules

UNROLLED = 64  # rules whose patterns become literals of the plan

# Case-insensitive for any script, Unicode classes, and only a newline ends a line.
_FLAGS = "(?diuU)"


def matches(rule: Rule, value: Column) -> Column:
    """The rule's pattern is found in the line and its exclusion is not."""
    found = value.rlike(_FLAGS + rule.pattern)
    if rule.exclude_pattern:
        found = found & ~value.rlike(_FLAGS + rule.exclude_pattern)
    return found


def may_match(rules: Sequence[Rule], value: Column) -> Column:
    """False only for lines that no rule can match, found by plain text search.

    Non-ASCII lines always pass, since case folding can turn other letters into ASCII ones.
    """
    if not all(rule.literals for rule in rules):
        return F.lit(True)
    literals = sorted({text for rule in rules for text in rule.literals})
    # As a lambda's variable the lower-cased line is made once, not once per text.
    found = F.exists(
        F.array(F.lower(value)), lambda low: reduce(or_, (F.contains(low, F.lit(t)) for t in literals))
    )
    return found | (F.octet_length(value) != F.char_length(value))


def rule_hits(lines: DataFrame, rules: Rules = RULE_LIBRARY) -> DataFrame:
    """One row per (PS line, matching rule): file, line_no, value, elapsed_ms, rule_ord.

    A single pass without a shuffle, for rules given as tuples or as rows. Up to ``UNROLLED``
    rules, almost every line leaves at the text search, and the rules are unrolled into one array,
    so that each pattern is a literal and compiles once. More rules are searched for together.
    """
    rules = as_rules(rules)
    if not rules:
        raise ValueError("at least one rule is needed")
    narrow = lines.select("file", "line_no", "value")
    value = F.col("value")
    elapsed = F.coalesce(ps_elapsed_ms(value), F.lit(0)).alias("elapsed_ms")
    if len(rules) > UNROLLED:
        return _hits_of_many(narrow, rules).select("file", "line_no", "value", elapsed, "rule_ord")
    fired = F.array(
        *[F.when(matches(rule, value), F.lit(i)).otherwise(F.lit(-1)) for i, rule in enumerate(rules)]
    )
    return (
        # From the cheapest test to the dearest.
        narrow.filter(value.startswith("[") & may_match(rules, value) & is_ps_line(value))
        .select(
            "file",
            "line_no",
            "value",
            elapsed,
            F.explode(F.filter(fired, lambda i: i >= 0)).alias("rule_ord"),
        )
    )


def _hits_of_many(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    spark, value = lines.sparkSession, F.col("value")
    patterns = [(i, rule.pattern, rule.exclude_pattern) for i, rule in enumerate(rules)]
    table = spark.createDataFrame(patterns, "rule_ord INT, pattern STRING, exclude STRING")

    def holds(pattern: str) -> Column:
        return F.rlike(value, F.concat(F.lit(_FLAGS), pattern))

    return (
        with_candidates(lines.filter(value.startswith("[")), rules, "rule_ord")
        .join(F.broadcast(table), "rule_ord")  # one row per rule, at most MAX_RULES
        .filter(is_ps_line(value) & holds("pattern") & ~F.coalesce(holds("exclude"), F.lit(False)))
    )
