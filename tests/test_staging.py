from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline import staging


def test_staged_tables_live_in_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    staged = staging.stage(spark.range(10), "ten")
    assert staged.count() == 10
    assert all(f.startswith(f"file://{root}/") for f in staged.inputFiles())


def test_a_job_drops_its_staged_tables(spark):
    with staging.job_staging(spark):
        staged = staging.stage(spark.range(10), "ten")
        folder = Path(staged.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.parent.exists()


def test_size_check(spark, monkeypatch):
    table = spark.range(1000)
    assert staging.fits_broadcast(table)
    assert staging.fits_broadcast(table.limit(0))
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 100)
    assert not staging.fits_broadcast(table)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        staging.checkpoint_root(Session)


def test_a_table_measured_while_it_is_written_needs_no_job(spark, monkeypatch):
    table = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("text"), F.array("id").alias("ids")
    )
    plain, measured = staging.stage(table, "plain"), staging.stage(table, "measured", measured=True)
    assert sorted(measured.collect(), key=str) == sorted(plain.collect(), key=str)
    size = plain.agg(staging._size(plain)).first()[0]
    assert measured._measured_bytes == size > 0
    assert staging.stage(table.limit(0), "none", measured=True)._measured_bytes == 0
    context = spark.sparkContext
    context.setJobGroup("measured", "")
    for bound in (size, size - 1):
        monkeypatch.setattr(staging, "BROADCAST_BYTES", bound)
        assert staging.fits_broadcast(measured) == (bound == size)
    assert len(context.statusTracker().getJobIdsForGroup("measured")) == 0
    assert not staging.fits_broadcast(plain)
    assert len(context.statusTracker().getJobIdsForGroup("measured")) > 0
    context.setJobGroup("", "")
