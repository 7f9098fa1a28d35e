"""Scan: ranked findings of a corpus, and the reports written from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import templates as tpl
from faultline.functions.vectors import Embedder, hash_embedding
from faultline.operators.assemble import assemble_entries
from faultline.operators.findings import file_verdicts, rank_findings, rule_findings
from faultline.operators.rare import (
    MAX_PER_FILE_IN_SCAN,
    first_per_text,
    rare_findings,
    without_rule_lines,
)
from faultline.plans.train import MIN_SIMILARITY, SIM_THRESHOLD, resolve
from faultline.rules import RULE_LIBRARY, Rules
from faultline.sinks.reports import write_reports
from faultline.sources.logs import list_files, read_lines
from faultline.sources.model import Model, load_model
from faultline.staging import job_staging, stage


class Report(NamedTuple):
    """What a scan found: one row per finding, one row per file."""

    findings: DataFrame
    verdicts: DataFrame


def scan(
    lines: DataFrame,
    model: Model | None = None,
    rules: Rules = RULE_LIBRARY,
    max_rare: int = MAX_PER_FILE_IN_SCAN,
    sim_threshold: float = SIM_THRESHOLD,
    min_similarity: float = MIN_SIMILARITY,
    embedder: Embedder = hash_embedding,
) -> DataFrame:
    """Ranked findings of numbered lines; without a trained model, of the rules only."""
    by_rule = stage(rule_findings(lines, rules), "rule-findings")
    if model is None or model.normal_ids is None or model.normal_ids.isEmpty():
        return rank_findings(by_rule)
    entries = stage(assemble_entries(lines), "entries")
    firsts = stage(first_per_text(entries), "first-lines")
    masked = F.col("masked")
    texts = (
        firsts.select("masked")
        .distinct()
        .select(
            "masked", tpl.n_tokens(masked).alias("n"), tpl.prefix(masked).alias("prefix")
        )
    )
    resolved = resolve(texts, model, sim_threshold, min_similarity, embedder)
    novel = without_rule_lines(
        rare_findings(firsts, entries, resolved, model.normal_ids, max_rare), by_rule
    )
    return rank_findings(by_rule.unionByName(stage(novel, "novel")))


def find(
    spark: SparkSession,
    log_dir: str,
    out_dir: str,
    model_dir: str | None = None,
    rules: Rules = RULE_LIBRARY,
    max_rare: int = MAX_PER_FILE_IN_SCAN,
    sim_threshold: float = SIM_THRESHOLD,
    min_similarity: float = MIN_SIMILARITY,
    embedder: Embedder = hash_embedding,
) -> Report | None:
    """Scan a directory of logs and write its reports; None if it holds no log file."""
    files = list_files(spark, log_dir)
    if files.isEmpty():
        return None
    with job_staging(spark):
        findings = stage(
            scan(
                read_lines(spark, log_dir, files),
                load_model(spark, model_dir),
                rules,
                max_rare,
                sim_threshold,
                min_similarity,
                embedder,
            ),
            "findings",
        )
        write_reports(findings, stage(file_verdicts(findings, files), "verdicts"), out_dir)
    return Report(
        spark.read.parquet(f"{out_dir}/findings"), spark.read.parquet(f"{out_dir}/verdicts")
    )
