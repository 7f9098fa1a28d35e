"""Every query against its SQL counterpart, on the smallest given tables."""

import hashlib
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as contract
from checks.blake_sql import blake2b
from checks.compare import connect, differences
from checks.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_the_hash_in_sql(duck):
    messages = ["", "w:abc", "3:é x", "a" * 127, "b" * 128, *(f"w:{i}" for i in range(300))]
    duck.register("hashed_messages", pd.DataFrame({"message": messages}))
    rows = duck.execute(f"WITH {blake2b('hashed_messages', 'message', 'coded')} FROM coded").fetchall()
    assert dict(rows) == {
        m: int.from_bytes(hashlib.blake2b(m.encode(), digest_size=8).digest(), "little") for m in messages
    }


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR).toPandas()
    if name in contract.oracle_sql():
        assert differences(result, duck.execute(contract.oracle_sql()[name]).df()) is None
    else:
        assert len(result) > 0
