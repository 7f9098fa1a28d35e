"""A corpus of many files is written once and listed in few tasks."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import tables
from faultline.sources import logs
from faultline.sources.logs import list_files

KINDS = ("error", "view", "signup", "purchase", "click")


def events_table(spark, folder, n=240, days=12):
    """Events of four devices on days of one and of two digits."""
    start = dt.datetime(2024, 1, 1)
    step = dt.timedelta(days=days) / n
    rows = [(i, start + i * step, i % 40, KINDS[i % 5]) for i in range(n)]
    schema = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_sides_are_the_files_that_their_rule_names(spark, tmp_path):
    corpus = tables.log_corpus(spark, events_table(spark, tmp_path))

    def names(path):
        files = list_files(spark, path).select(tables.corpus_file(F.col("file")).alias("file"))
        return files.withColumns(tables.file_parts())

    every = names(corpus)
    for side in tables.SIDE_NAMES:
        wanted = {row["file"] for row in every.filter(side).collect()}
        assert wanted and {row["file"] for row in names(tables.side_of(corpus, side)).collect()} == wanted


def test_the_reports_write_their_corpus_once(spark, tmp_path, monkeypatch):
    written = []
    write = tables._write_logs
    monkeypatch.setattr(
        tables, "_write_logs", lambda lines, path, **o: (written.append(path), write(lines, path, **o))
    )
    found = contract.queries()["find_reports"](spark, events_table(spark, tmp_path))
    assert found.filter("kind = 'json'").count() > 0
    assert len(written) == 1


def test_folders_are_listed_many_to_a_task(spark, tmp_path):
    most = logs.LISTING_WAVES * spark.sparkContext.defaultParallelism
    for i in range(3 * most):
        folder = tmp_path / f"file={i}"
        folder.mkdir()
        (folder / "part.log").write_text("[1.000] [t] [C] x\n")
    before = spark.conf.get(logs._LISTING_CONF)
    context = spark.sparkContext
    context.setJobGroup("listing", "listing of many folders")
    try:
        assert list_files(spark, f"{tmp_path}/file=*").count() == 3 * most
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= most
    assert spark.conf.get(logs._LISTING_CONF) == before
