"""Row types shared by the operators."""

from __future__ import annotations

RAW_LINES = "file STRING, line_no BIGINT, value STRING"

ENTRIES = (
    "file STRING, line_no BIGINT, elapsed_ms BIGINT, component STRING, level STRING, message STRING"
)

RULES = (
    "rule_ord INT, name STRING, category STRING, severity STRING, pattern STRING, "
    "description STRING, exclude_pattern STRING, burst_min INT, burst_window_s DOUBLE, "
    "context_before INT, context_after INT"
)

TEMPLATES = (
    "event_id STRING, n INT, prefix STRING, tokens ARRAY<STRING>, template STRING, "
    "ord BIGINT, n_lines BIGINT"
)

EMBEDDINGS = "event_id STRING, vec ARRAY<FLOAT>"

NORMAL_IDS = "event_id STRING"

# The columns of a finding, in report order.
FINDING_FIELDS = [
    "rule_name", "category", "severity", "description", "line_number", "timestamp", "elapsed_ms",
    "component", "trigger_line", "context_before", "context_after", "burst_line_numbers",
    "burst_size", "classifier_attention", "rare_template", "actionability_score",
]
