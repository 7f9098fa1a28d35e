"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables
from faultline import find, scan, train
from faultline.functions import templates as tpl
from faultline.functions import vectors as vec
from faultline.functions.lines import is_ps_line, ps_fields, raw_meta
from faultline.functions.scoring import has_error_hint
from faultline.operators.assemble import assemble_entries
from faultline.operators.bursts import burst_clusters, burst_settings
from faultline.operators.findings import (
    corpus_summary,
    file_verdicts,
    rank_findings,
    rule_findings,
    rule_triggers,
)
from faultline.operators.matching import (
    match_texts,
    resolve_texts,
    tag_entries,
    template_text,
)
from faultline.operators.mining import (
    count_lines,
    distinct_masked,
    mine_templates,
    number_templates,
)
from faultline.operators.neighbours import embedding_index, resolve_events
from faultline.operators.rare import (
    first_error_per_template,
    first_per_text,
    known_ids,
    rare_findings,
    with_entry,
    without_rule_lines,
)
from faultline.operators.rule_hits import rule_hits
from faultline.plans.train import resolve, train_entries
from faultline.rules import RULE_LIBRARY, rules_table
from faultline.sinks.reports import json_report, markdown_report, summary_report
from faultline.sources.logs import list_files, read_lines
from faultline.sources.model import Model, load_model
from faultline.staging import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]


def _joined(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), "\n")


def _big(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


# Lines and entries


def corpus_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not UTF-8, and lines that end in other ways, decoded and numbered."""
    return read_lines(spark, tables.encoded_corpus(spark, sf_dir)).select(
        tables.corpus_file(F.col("file")).alias("file"), "line_no", "value"
    )


def ps_line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.log_lines(spark, sf_dir).filter(is_ps_line(F.col("value")))
    fields = [c.alias(name) for name, c in ps_fields(F.col("value")).items()]
    return lines.select("file", "line_no", *fields)


def raw_line_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = [c.alias(name) for name, c in raw_meta(F.col("value")).items()]
    return tables.log_lines(spark, sf_dir).select("file", "line_no", *meta)


def entry_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_entries(tables.log_lines(spark, sf_dir))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, tables.log_corpus(spark, sf_dir)).select(
        tables.corpus_file(F.col("file")).alias("file"), "line_no", "value"
    )


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_files(spark, tables.log_corpus(spark, sf_dir)).select(
        tables.corpus_file(F.col("file")).alias("file"), "file_ord"
    )


# Rules


def rule_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that carry each rule's pattern, from all rules: zero counts are kept."""
    hits = rule_hits(tables.log_lines(spark, sf_dir)).groupBy("rule_ord").agg(
        F.count(F.lit(1)).alias("hits")
    )
    return (
        rules_table(spark)
        .join(hits, "rule_ord", "left")
        .select(
            "name", "category", "severity", "description",
            F.col("burst_min").isNotNull().alias("is_burst"),
            _big("context_before"), _big("context_after"),
            F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"),
        )
    )


def rule_hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(tables.log_lines(spark, sf_dir)).select(
        "file", "line_no", _big("rule_ord"), "value", "elapsed_ms"
    )


def device_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of rules given as a table, one for each user of the events."""
    user = F.col("user_id").cast("string")
    rules = tables.read(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("user_"), F.lpad(user, 9, "0")).alias("name"),
        F.lit("User").alias("category"),
        F.lit("LOW").alias("severity"),
        F.concat(F.lit(r"\buser "), user, F.lit(r" \w+ ok$|queue full, "), user, F.lit(" waiting")).alias("pattern"),
        F.lit("A line of one user").alias("description"),
    )
    return rule_hits(tables.log_lines(spark, sf_dir), rules).select(
        "file", "line_no", _big("rule_ord"), "value", "elapsed_ms"
    )


def burst_cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rule_hits(tables.log_lines(spark, sf_dir))
    return burst_clusters(hits, burst_settings(spark, RULE_LIBRARY)).select(
        "file", _big("rule_ord"), "line_no", _big("size"), _joined("lines").alias("lines")
    )


def rule_findings_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_findings(stage(tables.log_lines(spark, sf_dir), "log"))
    return found.select(
        "file", "rule_name", "category", "severity", "description", "line_number", "timestamp",
        "elapsed_ms", "component", "trigger_line", _big("burst_size"),
        *[
            _joined(name).alias(name)
            for name in ("context_before", "context_after", "burst_line_numbers")
        ],
    )


def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_findings(rule_triggers(tables.log_lines(spark, sf_dir))).select(
        "file", "rank", "rule_name", "line_number", "severity",
        F.round("actionability_score", 6).alias("actionability_score"),
    )


def _daily_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.log_lines(spark, sf_dir, daily=True).select("file").distinct()


def _daily_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = rule_triggers(tables.log_lines(spark, sf_dir, daily=True))
    return file_verdicts(triggers, _daily_files(spark, sf_dir))


def verdict_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_verdicts(spark, sf_dir).select("file", "verdict", "findings", "severity.*")


def summary_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _daily_verdicts(spark, sf_dir)
    return corpus_summary(verdicts).select("total_files", "verdict_counts.*")


# Templates


def _masking(messages: DataFrame) -> DataFrame:
    masked = tpl.masked_text(F.col("message"))
    return messages.select(
        "*",
        masked.alias("masked"),
        tpl.n_tokens(masked).cast("bigint").alias("n"),
        tpl.prefix(masked).alias("prefix"),
        F.array_join(tpl.params(F.col("message")), "\n").alias("params"),
    ).drop("message")


def mask_log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = assemble_entries(tables.log_lines(spark, sf_dir))
    return _masking(entries.select("file", "line_no", "message"))


def mask_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masking(tables.document_lines(spark, sf_dir))


def error_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = assemble_entries(tables.log_lines(spark, sf_dir))
    return entries.select(
        "file", "line_no", has_error_hint(F.col("message")).alias("hinted")
    )


def _log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the daily logs with their position and whether it is healthy."""
    entries = assemble_entries(tables.log_lines(spark, sf_dir, daily=True))
    device, day = tables.file_parts().values()
    normal = (day == tables.HEALTHY_DAY) & (F.col("component") != tables.NEW_COMPONENT)
    # Far more room than a file has lines.
    place = (device * 1000 + day) * 1_000_000_000 + F.col("line_no")
    return entries.withColumns({"pos": place, "normal": normal})


def _dictionary(texts: DataFrame) -> DataFrame:
    # The look-up takes the tokens from the template.
    return stage(number_templates(mine_templates(texts)).drop("tokens"), "dictionary")


def _template_rows(templates: DataFrame) -> DataFrame:
    return templates.select("event_id", _big("n"), "prefix", "template", "ord", "n_lines")


def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = stage(distinct_masked(_log_entries(spark, sf_dir)), "texts")
    mined = _dictionary(texts)
    return _template_rows(count_lines(mined, match_texts(texts, mined)))


def document_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = stage(distinct_masked(tables.document_messages(spark, sf_dir)), "texts")
    mined = _dictionary(texts)
    return _template_rows(count_lines(mined, match_texts(texts, mined)))


def _healthy_model(spark: SparkSession, entries: DataFrame) -> Model:
    """Dictionary and ids of the healthy logs alone, without embeddings."""
    texts = stage(distinct_masked(entries.filter("normal")), "texts")
    mined = _dictionary(texts)
    return Model(mined, None, known_ids(match_texts(texts, mined)))


def frozen_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts against the dictionary of the healthy logs, with similarity and merge."""
    entries = _log_entries(spark, sf_dir)
    model = _healthy_model(spark, entries)
    matched = match_texts(distinct_masked(entries), model.templates)
    toks, template = tpl.tokens(F.col("masked")), tpl.tokens(F.col("template"))
    return matched.select(
        "masked",
        "event_id",
        "template",
        F.round(tpl.similarity(template, toks), 6).alias("similarity"),
        F.array_join(tpl.merge(template, toks), " ").alias("merged"),
    )


def tagged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _log_entries(spark, sf_dir)
    model = _healthy_model(spark, entries)
    resolved = resolve_texts(match_texts(distinct_masked(entries), model.templates), None)
    tagged = tag_entries(entries.select("file", "line_no", "message"), resolved)
    return tagged.select(
        "file", "line_no", "event_id", "template", F.array_join("params", "\n").alias("params"),
        "resolved_via_oov",
    )


def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template text of the id of every entry; unknown ids come back as they are."""
    entries = _log_entries(spark, sf_dir)
    model = _healthy_model(spark, entries)
    resolved = resolve_texts(match_texts(distinct_masked(entries), model.templates), None)
    tagged = tag_entries(entries.select("file", "line_no", "message"), resolved)
    return template_text(tagged.select("file", "line_no", "event_id"), model.templates)


def tagged_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagging with the hash embedding behind it: unmatched texts go to a near template."""
    entries = _log_entries(spark, sf_dir)
    model = _healthy_model(spark, entries)
    known = stage(
        vec.embed_templates(model.templates.select("event_id", "template"), "template").drop(
            "template"
        ),
        "embeddings",
    )
    resolved = resolve(distinct_masked(entries), model._replace(embeddings=known))
    tagged = tag_entries(entries.select("file", "line_no", "message"), resolved)
    return tagged.select(
        "file", "line_no", "event_id", "resolved_via_oov",
        F.round("oov_similarity", 4).alias("oov_similarity"),
    )


def tagged_by_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagging with an embedder that the caller supplies."""
    entries = _log_entries(spark, sf_dir)
    model = _healthy_model(spark, entries)
    known = stage(
        vec.embed_templates(
            model.templates.select("event_id", "template"), "template", tables.md5_embedding
        ).drop("template"),
        "embeddings",
    )
    resolved = resolve(
        distinct_masked(entries), model._replace(embeddings=known), embedder=tables.md5_embedding
    )
    tagged = tag_entries(entries.select("file", "line_no", "message"), resolved)
    return tagged.select(
        "file", "line_no", "event_id", "template", "resolved_via_oov",
        F.round("oov_similarity", 4).alias("oov_similarity"),
    )


# Vectors


def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    unit = vectors.withColumn("unit", vec.l2_normalise(F.col("embedding")))
    return unit.select(
        "vec_id",
        F.round(vec.norm(F.col("embedding")), 5).alias("length"),
        F.round(vec.norm(F.col("unit")), 5).alias("unit_length"),
        F.size("unit").cast("bigint").alias("dim"),
    )


def _unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        tables.read(spark, sf_dir, "embeddings").select(
            F.col("vec_id").cast("string").alias("event_id"),
            vec.l2_normalise(F.col("embedding")).alias("vec"),
            "label",
        ),
        "vectors",
    )


def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector resolved against those of label 0."""
    vectors = _unit_vectors(spark, sf_dir)
    known = vectors.filter("label = 0").select("event_id", "vec")
    return resolve_events(vectors.select("event_id", "vec"), known, 0.3).select(
        "event_id", "resolved_id", F.round("similarity", 5).alias("similarity")
    )


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_index(_unit_vectors(spark, sf_dir))


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding of every distinct masked line of the documents."""
    texts = distinct_masked(tables.document_messages(spark, sf_dir)).select("masked")
    embedded = vec.embed_templates(texts, "masked")
    # Weights that cancel out leave no more than rounding.
    signs = F.transform(
        "vec",
        lambda x, slot: F.when(F.abs(x) > 1e-6, F.concat(F.when(x > 0, "+").otherwise("-"), slot)),
    )
    used = F.array_compact(signs)
    return embedded.select(
        "masked",
        F.round(vec.norm(F.col("vec")), 5).alias("length"),
        F.size(used).cast("bigint").alias("slots"),
        F.array_join(used, " ").alias("signs"),
    )


# Novel templates and whole scans


def normal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _log_entries(spark, sf_dir)
    texts = stage(distinct_masked(entries), "texts")
    return known_ids(match_texts(texts, _dictionary(texts)).filter("normal"))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    entries = stage(_log_entries(spark, sf_dir), "entries")
    texts = stage(distinct_masked(entries), "texts")
    mined = _dictionary(texts)
    matched = match_texts(texts, mined)
    return entries, Model(mined, None, stage(known_ids(matched.filter("normal")), "normal"))


def rare_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, model = _trained(spark, sf_dir)
    resolved = resolve(distinct_masked(entries), model)
    return with_entry(first_error_per_template(first_per_text(entries), resolved), entries)


def rare_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, model = _trained(spark, sf_dir)
    resolved = resolve(distinct_masked(entries), model)
    rare = rare_findings(
        first_per_text(entries), entries, resolved, model.normal_ids, max_per_file=2
    )
    ruled = rule_triggers(tables.log_lines(spark, sf_dir, daily=True))
    return without_rule_lines(rare, ruled).select(
        "file", "line_number", "description", "timestamp", "elapsed_ms", "component",
        "trigger_line",
    )


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _trained(spark, sf_dir)
    return scan(stage(tables.log_lines(spark, sf_dir, daily=True), "log"), model)


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).select(
        "file", "rank", "rule_name", "severity", "line_number", "trigger_line", "rare_template",
        F.round("actionability_score", 6).alias("actionability_score"),
        _joined("context_before").alias("context_before"),
        _joined("context_after").alias("context_after"),
    )


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    findings = stage(_scan(spark, sf_dir), "findings")
    return findings, file_verdicts(findings, _daily_files(spark, sf_dir))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_report(*_reported(spark, sf_dir))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_report(*_reported(spark, sf_dir))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_report(_daily_verdicts(spark, sf_dir)).select("file", _big("seq"), "text")


def train_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training on the documents, through the saved model."""
    model_dir = new_folder(spark, "model")
    train_entries(tables.document_messages(spark, sf_dir), model_dir)
    model = load_model(spark, model_dir)
    normal = model.normal_ids.withColumn("normal", F.lit(True))
    return (
        model.templates.join(model.embeddings, "event_id")
        .join(normal, "event_id", "left")
        .select(
            "event_id", "template", "n_lines", F.coalesce("normal", F.lit(False)).alias("normal")
        )
    )


def find_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files on disk to verdicts: read, number, apply rules, roll up."""
    path = tables.log_corpus(spark, sf_dir)
    files = list_files(spark, path)
    findings = scan(read_lines(spark, path, files))
    return file_verdicts(findings, files).select(
        tables.corpus_file(F.col("file")).alias("file"), "verdict", "findings", "severity.*"
    )


def _train_directories(
    spark: SparkSession,
    corpus: str,
    normal: str = tables.NORMAL_FILES,
    anomaly: str = tables.ANOMALY_FILES,
) -> str:
    model_dir = new_folder(spark, "model")
    train(
        spark,
        tables.side_of(corpus, normal),
        tables.side_of(corpus, anomaly),
        model_dir,
        embedder=tables.md5_embedding,
    )
    return model_dir


def train_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training on two directories that hold the logs of two devices each, as saved."""
    model_dir = _train_directories(spark, tables.log_corpus(spark, sf_dir))
    return _saved_model(load_model(spark, model_dir))


def train_all_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training on two directories, of the healthy day's files and of all others, as saved."""
    corpus = tables.log_corpus(spark, sf_dir)
    model_dir = _train_directories(spark, corpus, tables.HEALTHY_FILES, tables.OTHER_FILES)
    return _saved_model(load_model(spark, model_dir))


def _saved_model(model: Model) -> DataFrame:
    """Templates, sums of their vectors, healthy ids."""
    total = F.aggregate("vec", F.lit(0.0), lambda done, x: done + x.cast("double"))
    return (
        model.templates.join(model.embeddings.select("event_id", "vec"), "event_id")
        .join(model.normal_ids.withColumn("normal", F.lit(True)), "event_id", "left")
        .select(
            "event_id", "template", "n_lines", F.coalesce("normal", F.lit(False)).alias("normal"),
            F.round(total, 4).alias("vec_sum"),
        )
    )


def find_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all reports that a scan of every file writes, without file names.

    The model is trained on every file as well.
    """
    corpus = tables.log_corpus(spark, sf_dir)
    model_dir = _train_directories(spark, corpus, tables.HEALTHY_FILES, tables.OTHER_FILES)
    out = new_folder(spark, "reports")
    find(spark, corpus, out, model_dir, embedder=tables.md5_embedding)
    written = [
        spark.read.text(f"{out}/{kind}").select(F.lit(kind).alias("kind"), "value")
        for kind in ("json", "md", "summary")
    ]
    # Spark names the files of the corpus; the names come back without their part of the path.
    named = F.regexp_replace("value", r'"file":"[^"]*file=(f[^/"]+)/[^"]*"', '"file":"$1"')
    text = F.regexp_replace(named, r"part-[^\"`]*\.log", "")
    return written[0].unionByName(written[1]).unionByName(written[2]).select("kind", text.alias("text"))


QUERIES: dict[str, Query] = {
    "corpus_files": corpus_files,
    "corpus_lines": corpus_lines,
    "corpus_encodings": corpus_encodings,
    "ps_fields": ps_line_fields,
    "raw_meta": raw_line_meta,
    "entry_assembly": entry_assembly,
    "rule_library": rule_library,
    "rule_hits": rule_hit_lines,
    "device_rules": device_rules,
    "rule_findings_context": rule_findings_context,
    "burst_clusters": burst_cluster_lines,
    "findings_ranked": findings_ranked,
    "file_verdicts": verdict_per_file,
    "corpus_summary": summary_of_corpus,
    "mask_log_messages": mask_log_messages,
    "mask_document_lines": mask_document_lines,
    "error_hints": error_hints,
    "log_templates": log_templates,
    "document_templates": document_templates,
    "frozen_match": frozen_match,
    "tagged_entries": tagged_entries,
    "dictionary_lookup": dictionary_lookup,
    "tagged_by_similarity": tagged_by_similarity,
    "tagged_by_embedder": tagged_by_embedder,
    "vector_norm": vector_lengths,
    "nearest_neighbour": nearest_neighbour,
    "embedding_index": embedding_rows,
    "hash_embeddings": hash_embeddings,
    "normal_ids": normal_ids,
    "rare_first_seen": rare_first_seen,
    "rare_capped": rare_capped,
    "scan_findings": scan_findings,
    "report_json": report_json,
    "report_markdown": report_markdown,
    "report_summary": report_summary,
    "train_job": train_job,
    "find_job": find_job,
    "train_directories": train_directories,
    "train_all_directories": train_all_directories,
    "find_reports": find_reports,
}
