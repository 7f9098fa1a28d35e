"""The rule library: what a finding looks like in a raw line."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from faultline import schemas


class Rule(NamedTuple):
    """One signature. With ``burst_min`` and ``burst_window_s`` set it fires on clusters only.

    ``literals`` may name texts, in lower case, of which every matching line holds at least
    one, in any case. The scan then skips the pattern on lines without them; leaving it empty
    costs time, never results.
    """

    name: str
    category: str
    severity: str
    pattern: str
    description: str
    exclude_pattern: str | None = None
    burst_min: int | None = None
    burst_window_s: float | None = None
    context_before: int = 5
    context_after: int = 5
    literals: tuple[str, ...] = ()

    @property
    def is_burst(self) -> bool:
        return self.burst_min is not None and self.burst_window_s is not None


# Names, texts, patterns and numbers that results must reproduce.
RULE_LIBRARY: tuple[Rule, ...] = (
    Rule(
        "use_after_free_timer", "Memory Safety", "CRITICAL",
        r"check_for_bad_handle.*already free|already free.*timer|use[- ]after[- ]free",
        "Use-after-free on a kernel timer handle",
        context_before=8, context_after=8,
        literals=("already free", "after-free", "after free"),
    ),
    Rule(
        "deauth_reason_07_class3_frame", "802.11 Protocol Violation", "CRITICAL",
        r"Deauthenticated\s*\(reason\s*0x0?7\)",
        "AP sent Deauth reason 0x07 (Class 3 frame from non-associated STA)",
        context_before=10, context_after=10,
        literals=("deauthenticated",),
    ),
    Rule(
        "deauth_reason_0f_cipher_mismatch", "802.11 Protocol Violation", "CRITICAL",
        r"Deauthenticated\s*\(reason\s*0x0?f\)",
        "AP sent Deauth reason 0x0F (group cipher / 4-way handshake failure)",
        context_before=10, context_after=10,
        literals=("deauthenticated",),
    ),
    Rule(
        "deauth_unexpected_reason", "802.11 Protocol Violation", "HIGH",
        r"Deauthenticated\s*\(reason\s*0x[0-9a-f]+\)",
        "AP-initiated deauth with explicit reason code",
        exclude_pattern=r"reason\s*0x0?[7f]\b",
        context_before=10, context_after=10,
        literals=("deauthenticated",),
    ),
    Rule(
        "firmware_diagnostic_error", "Firmware Error Report", "CRITICAL",
        r"Log Type:\s*DIAGNOSTIC\s*Error Msg:",
        "Firmware emitted a DIAGNOSTIC-level Error report",
        context_before=5, context_after=15,
        literals=("error msg:",),
    ),
    Rule(
        "firmware_error_burst", "Firmware Error Report", "CRITICAL",
        r"\|SSPLogger\s*\|Error:",
        "Burst of SSPLogger error messages (likely firmware crash dump)",
        burst_min=5, burst_window_s=2.0, context_before=3, context_after=20,
        literals=("|error:",),
    ),
    Rule(
        "association_rejected_with_status", "802.11 Protocol Failure", "HIGH",
        r"ASSOC_RESP[: ].*Association Failed.*status code\s*=\s*\d+",
        "AP rejected association with an explicit status code",
        context_before=8, context_after=4,
        literals=("association failed",),
    ),
    Rule(
        "background_scan_failed", "Driver Operation Failure", "HIGH",
        r"WIFI_SET_BACKGROUND_SCAN_CNF with result failure",
        "Background scan request returned a failure CNF",
        literals=("wifi_set_background_scan_cnf",),
    ),
    Rule(
        "tx_queue_overflow_storm", "Resource Exhaustion", "HIGH",
        r"SDPQueueManager.*classic queue full|TreckNetworkAdapter send failure",
        "Sustained TX queue overflow (driver back-pressure failure)",
        burst_min=10, burst_window_s=5.0, context_before=4, context_after=4,
        literals=("classic queue full", "trecknetworkadapter send failure"),
    ),
    Rule(
        "watchdog_or_hard_reset", "System Reset", "HIGH",
        r"\bwatchdog\b.*\b(timeout|triggered|fired|reset)\b|kernel panic|forced reboot",
        "Watchdog or kernel panic event observed",
        exclude_pattern=r"RNDIS|hardReset",
        context_before=15, context_after=10,
        literals=("watchdog", "kernel panic", "forced reboot"),
    ),
)


Rules = Sequence[Rule] | DataFrame
MAX_RULES = 100_000  # rules given as rows are read by the driver, as their patterns are the plan


def as_rules(rules: Rules) -> tuple[Rule, ...]:
    """Rules in evaluation order, from tuples or from a table.

    A table has a row per rule, with columns named as a rule's fields (name, category, severity,
    pattern and description at least), in the order of ``rule_ord`` if it has one, else of ``name``.
    """
    if not isinstance(rules, DataFrame):
        return tuple(rules)
    order = "rule_ord" if "rule_ord" in rules.columns else "name"
    fields = [field for field in Rule._fields if field in rules.columns]
    rows = rules.orderBy(order).select(*fields).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    given = ({f: row[f] for f in fields if row[f] is not None} for row in rows)
    return tuple(Rule(**{**row, "literals": tuple(row.get("literals", ()))}) for row in given)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULE_LIBRARY) -> DataFrame:
    """The rules as a small table, one row per rule in evaluation order."""
    # The last field, literals, only speeds up the scan.
    return spark.createDataFrame([(i, *rule[:-1]) for i, rule in enumerate(rules)], schemas.RULES)
