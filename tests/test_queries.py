"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import hashlib
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: ANN001
    problem = compare(spark, duck, QUERIES[name], SQL[name], SF)
    assert problem is None, problem


def test_only_sha512_and_training_data_have_no_sql():
    own = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}
    assert own - set(SQL) == {"l9_sha512"}


def test_sha512(spark):  # noqa: ANN001
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["l9_sha512"](spark, SF).collect():
        assert r.sha512_hex == hashlib.sha512(texts[r.doc_id].encode()).hexdigest()


def test_entry_has_rows_and_a_stable_schema(spark):  # noqa: ANN001
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "start_lsn", "seqval"]
    assert df.count() > 0
