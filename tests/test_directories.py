"""Training from directories sees every event."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import tables
from faultline.operators.assemble import assemble_entries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


def test_each_file_is_in_one_directory(spark):
    files = tables.log_lines(spark, SF_DIR, daily=True).withColumns(tables.file_parts())
    sides = [F.expr(side).cast("int") for side in (tables.HEALTHY_FILES, tables.OTHER_FILES)]
    assert [tuple(r) for r in files.select((sides[0] + sides[1]).alias("n")).distinct().collect()] == [(1,)]


def test_every_entry_is_trained_on(spark):
    trained = contract.queries()["train_all_directories"](spark, SF_DIR)
    entries = assemble_entries(tables.log_lines(spark, SF_DIR, daily=True))
    assert trained.agg(F.sum("n_lines")).first()[0] == entries.count()
