"""The registered queries on the smallest given tables, and the pipeline against plain stages."""

from pathlib import Path

import pandas as pd
import pytest

import corpus_pipeline
from checks.compare import connect, differences
from faultline.llm import quality
from faultline.llm.queries import ORACLES, QUERIES
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry_registers_every_query():
    import __spark_entry__ as contract

    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert differences(result, duck.execute(ORACLES[name]).df()) is None
    else:
        documents = pd.read_parquet(f"{SF_DIR}/documents.parquet")
        assert set(result["doc_id"]) == set(documents["doc_id"])


def test_pipeline_equals_plain_stages(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet").astype({"item_id": str})
    verdicts = quality.quality_rules(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    kept = {r["doc_id"] for r in verdicts if r["kept"]}
    texts = [(i, t) for i, t in zip(docs["doc_id"], docs["text"]) if i in kept]
    texts = [(i, text) for i, (text, _, _) in plain.line_dedup(texts).items()]
    roots = plain.groups({i: plain.simhash(t) for i, t in texts})
    benchmark = list(zip(items["item_id"], items["text"]))
    left = {
        i: t for i, t in texts if roots[i] == i and not plain.contamination(t, benchmark)[3]
    }
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(left)
    assert 0 < len(left) < len(docs)
    totals = {r["doc_id"]: r["doc_tokens"] for r in rows}
    lengths: dict = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == totals


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("source", "kept")
    columns = docs.columns
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF_DIR)
        assert docs.columns == columns
    empty = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, SF_DIR).count() == 0
