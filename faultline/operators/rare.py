"""Novel templates: error-looking templates that no healthy log ever showed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import templates as tpl
from faultline.functions.scoring import has_error_hint
from faultline.operators.matching import join_unique
from faultline.staging import fits_broadcast, stage

# Texts of the finding and the default caps.
RULE_NAME, CATEGORY, SEVERITY = "rare_template", "Novel Log Template", "MEDIUM"
DESCRIPTION = 'Log template not present in any normal-training file: "%s"'
QUOTED_CHARS = 120
MAX_PER_FILE = 20
MAX_PER_FILE_IN_SCAN = 15
SOURCE_ORD = 1_000_000  # after every rule

_FIELDS = ["line_no", "elapsed_ms", "component", "message"]


def known_ids(resolved: DataFrame) -> DataFrame:
    """The ids that occur: distinct, without the unknown id."""
    return (
        resolved.filter(F.col("event_id").isNotNull() & ~F.col("event_id").isin("", tpl.UNKNOWN_ID))
        .select("event_id")
        .distinct()
    )


def first_per_text(entries: DataFrame) -> DataFrame:
    """Per (file, masked text) the first line, and the first whose message shows an error.

    This runs before any join on the text: a text that fills a third of the corpus shrinks to
    one row per file in the map-side half of the aggregation, which holds two numbers per text;
    the entries themselves are looked up when only the findings are left.
    """
    hinted = F.when(has_error_hint(F.col("message")), F.col("line_no"))
    return (
        entries.select(
            "file", "line_no", hinted.alias("hinted"), tpl.masked_text(F.col("message")).alias("masked")
        )
        .groupBy("file", "masked")
        .agg(F.min("line_no").alias("first_line"), F.min("hinted").alias("first_hinted"))
    )


def first_error_per_template(firsts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per file and template the first line whose template or message shows an error."""
    tags = stage(
        resolved.select("masked", "event_id", "template").filter(
            ~F.col("event_id").isin("", tpl.UNKNOWN_ID)
        ),
        "tags",
    )
    tagged = join_unique(firsts, tags, ["masked"], "inner")
    line = F.when(has_error_hint(F.col("template")), F.col("first_line")).otherwise(
        F.col("first_hinted")
    )
    return (
        tagged.select("file", "event_id", "template", line.alias("line_no"))
        .filter(F.col("line_no").isNotNull())
        .groupBy("file", "event_id", "template")
        .agg(F.min("line_no").alias("line_no"))
    )


def with_entry(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Add the fields of the entry at (file, line_no); ``found`` is the small side."""
    found = stage(found, "found-lines", measured=True)
    side = F.broadcast(found) if fits_broadcast(found) else found
    return entries.select("file", *_FIELDS).join(side, ["file", "line_no"])


def rare_findings(
    firsts: DataFrame,
    entries: DataFrame,
    resolved: DataFrame,
    normal_ids: DataFrame,
    max_per_file: int = MAX_PER_FILE,
) -> DataFrame:
    """The first ``max_per_file`` novel templates of each file, in line order, as findings.

    ``entries``, which ``firsts`` were taken from, are read once more and should be a written table.
    """
    candidates = first_error_per_template(firsts, resolved)
    normal = F.broadcast(normal_ids) if fits_broadcast(normal_ids) else normal_ids
    novel = candidates.join(normal, "event_id", "left_anti")
    # Spark keeps only this many rows per file before the shuffle.
    in_order = Window.partitionBy("file").orderBy("line_no")
    kept = with_entry(
        novel.withColumn("_nth", F.row_number().over(in_order))
        .filter(F.col("_nth") <= max_per_file)
        .select("file", "line_no", "template"),
        entries,
    )
    no_text, no_lines = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    return kept.select(
        "file",
        F.lit(SOURCE_ORD).alias("source_ord"),
        F.lit(RULE_NAME).alias("rule_name"),
        F.lit(CATEGORY).alias("category"),
        F.lit(SEVERITY).alias("severity"),
        F.format_string(DESCRIPTION, F.substring("template", 1, QUOTED_CHARS)).alias("description"),
        F.col("line_no").alias("line_number"),
        F.format_string("%.3f", F.col("elapsed_ms") / 1000).alias("timestamp"),
        "elapsed_ms",
        "component",
        F.col("message").alias("trigger_line"),
        no_text.alias("context_before"),
        no_text.alias("context_after"),
        no_lines.alias("burst_line_numbers"),
        F.lit(1).alias("burst_size"),
        F.lit(None).cast("double").alias("classifier_attention"),
        F.lit(True).alias("rare_template"),
    )


def without_rule_lines(rare: DataFrame, rule_findings: DataFrame) -> DataFrame:
    """Drop rare findings on a line that already has a rule finding."""
    return rare.join(
        rule_findings.select("file", "line_number"), ["file", "line_number"], "left_anti"
    )
