"""Per-file reports and the corpus summary, written as ordered lines of text.

A report is never gathered into one row: its header, every finding and its end are rows with
a running number. They are sorted by (report, number), with spilling, and each report is written as
one stream to one file, so its size is not bounded by memory. Spark's own writer commits the files;
then they get their names and take the place of older ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.folders import Folder
from faultline.functions.scoring import SEVERITIES, VERDICTS
from faultline.operators.findings import corpus_summary
from faultline.schemas import FINDING_FIELDS

# The keys and headings of the documents below are part of their format.
_KEEP_NULLS = {"ignoreNullFields": "false"}
FENCE = "```"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    as_object = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}
    return F.substr(as_object, F.lit(6), F.length(as_object) - F.lit(6))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def json_report(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JSON document of every file that has findings: file, seq, text."""
    dirty = verdicts.filter(F.col("findings") > 0)
    head = dirty.select(
        "file",
        F.lit(0).cast("bigint").alias("seq"),
        F.concat(
            F.lit('{"file":'), _quoted(F.col("file")),
            F.lit(',"verdict":"'), F.col("verdict"),
            F.lit('","finding_count":'), F.col("findings").cast("string"),
            F.lit(',"findings":['),
        ).alias("text"),
    )
    body = findings.select(
        "file",
        F.col("rank").alias("seq"),
        F.concat(
            F.when(F.col("rank") > 1, F.lit(",")).otherwise(F.lit("")),
            F.to_json(F.struct(*FINDING_FIELDS), _KEEP_NULLS),
        ).alias("text"),
    )
    end = dirty.select("file", (F.col("findings") + 1).alias("seq"), F.lit("]}").alias("text"))
    return head.unionByName(body).unionByName(end)


def markdown_report(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Markdown document of every file that has findings: file, seq, text."""
    counts = [
        F.when(
            F.col("severity")[name] > 0,
            F.format_string(f"`{name}`: %d", F.col("severity")[name]),
        )
        for name in SEVERITIES
    ]
    head = verdicts.filter(F.col("findings") > 0).select(
        "file",
        F.lit(0).cast("bigint").alias("seq"),
        _lines(
            F.format_string("# Anomaly Report: `%s`", file_name(F.col("file"))),
            "",
            F.format_string("**Verdict:** `%s`  |  **Findings:** %d", "verdict", "findings"),
            "",
            F.concat(F.lit("**Severity summary:** "), F.concat_ws("  ", *counts)),
            "",
        ).alias("text"),
    )
    trigger = F.col("trigger_line")
    burst = F.when(
        F.col("burst_size") > 1,
        F.format_string(
            "- **Burst size:** %d matches starting at line %d", "burst_size", "line_number"
        ),
    )
    indented = [
        F.transform(name, lambda line: F.concat(F.lit("  "), line))
        for name in ("context_before", "context_after")
    ]
    context = F.when(
        F.size("context_before") + F.size("context_after") > 0,
        _lines(
            "", "**Context:**", FENCE,
            F.concat_ws(
                "\n",
                F.concat(indented[0], F.array(F.concat(F.lit("> "), trigger)), indented[1]),
            ),
            FENCE,
        ),
    )
    body = findings.select(
        "file",
        F.col("rank").alias("seq"),
        # concat_ws leaves out the null parts, which are the optional sections.
        _lines(
            F.format_string("## %d. `%s` %s", "rank", "severity", "description"),
            "",
            F.format_string("- **Category:** %s", "category"),
            F.format_string(
                "- **Line:** %d  **Timestamp:** `%s`  **Component:** `%s`  "
                "**Actionability:** %.2f",
                "line_number", "timestamp", "component", "actionability_score",
            ),
            burst,
            "",
            "**Trigger line:**",
            FENCE,
            trigger,
            FENCE,
            context,
            "",
            "---",
            "",
        ).alias("text"),
    )
    return head.unionByName(body)


def summary_report(verdicts: DataFrame) -> DataFrame:
    """JSON document over all files, clean ones included: file, seq, text."""
    totals = corpus_summary(verdicts)
    tallies = ",".join(f'"{name}":%d' for name in VERDICTS)
    head = totals.select(
        F.lit("").alias("file"),
        F.lit(0).alias("seq"),
        F.format_string(
            f'{{"total_files":%d,"verdict_counts":{{{tallies}}},"files":[',
            "total_files",
            *[f"verdict_counts.{name}" for name in VERDICTS],
        ).alias("text"),
    )
    # The comma goes before each file but the first in path order.
    first = verdicts.agg(F.min("file")).scalar()
    row = F.to_json(
        F.struct(file_name(F.col("file")).alias("file"), "verdict", "findings", "severity")
    )
    comma = F.when(F.col("file") == first, F.lit("")).otherwise(F.lit(","))
    body = verdicts.select("file", F.lit(1).alias("seq"), F.concat(comma, row).alias("text"))
    end = totals.select(F.lit("").alias("file"), F.lit(2).alias("seq"), F.lit("]}").alias("text"))
    return head.unionByName(body).unionByName(end)


def write_documents(documents: DataFrame, path: str) -> None:
    """One file ``report`` below ``path`` per document, its texts in the order of seq.

    Older output there is replaced when all of the new one is written; if a task fails, the older
    output stays and nothing of the new one is left.
    """
    spark = documents.sparkSession
    parent, name = path.rstrip("/").rsplit("/", 1)
    folder = Folder(spark, parent)
    parts, whole = (f".{name}-{kind}-{uuid.uuid4().hex}" for kind in ("parts", "files"))
    try:
        (
            # A column that is never null keeps its order when Spark writes by it.
            documents.withColumn("report", F.coalesce("report", F.lit("")))
            .repartition("report")
            .sortWithinPartitions("report", "seq")
            .select("report", "text")
            .write.partitionBy("report")
            # A document is one task's stream, whatever the session's limit per file is.
            .option("maxRecordsPerFile", 0)
            .text(f"{parent}/{parts}")
        )
        _flatten(folder, parts, whole)
        folder.remove(name)
        folder.move(whole, name)
    finally:
        folder.remove(parts)
        folder.remove(whole)


def _flatten(folder: Folder, parts: str, whole: str) -> None:
    """Move the one file of each ``report=<name>`` folder to ``<name>``."""
    Folder(folder.spark, f"{folder.path}/{whole}").make()
    unescape = folder.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    moves = []
    for own in folder.names(parts):
        (file,) = folder.names(f"{parts}/{own}")
        moves.append((f"{parts}/{own}/{file}", f"{whole}/{unescape(own.split('=', 1)[1])}"))
    folder.move_all(moves)


def _per_file(report: DataFrame, suffix: str) -> DataFrame:
    return report.select(F.concat(file_stem(F.col("file")), F.lit(suffix)).alias("report"), "seq", "text")


def write_reports(findings: DataFrame, verdicts: DataFrame, out_dir: str) -> None:
    """Below ``out_dir``: findings and verdicts (parquet), and as single files
    json/<stem>.findings.json, md/<stem>.findings.md and summary/summary.json.

    Older output there is replaced.
    """
    findings.repartitionByRange("file", "rank").sortWithinPartitions(
        "file", "rank"
    ).write.mode("overwrite").parquet(f"{out_dir}/findings")
    verdicts.write.mode("overwrite").parquet(f"{out_dir}/verdicts")
    write_documents(_per_file(json_report(findings, verdicts), ".findings.json"), f"{out_dir}/json")
    write_documents(_per_file(markdown_report(findings, verdicts), ".findings.md"), f"{out_dir}/md")
    in_order = F.struct(F.col("seq") == 2, "file")
    summary = summary_report(verdicts).select(
        F.lit("summary.json").alias("report"), in_order.alias("seq"), "text"
    )
    write_documents(summary, f"{out_dir}/summary")
