"""Every registered query against its SQL on the smallest data folder."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, database
from checks.oracles import ORACLES
from checks.workload import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF, name) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(QUERIES["stream_ingest"](spark, str(tmp_path)).collect()) == sorted(QUERIES["stream_ingest"](spark, SF).collect())


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["query_id", "collection_id", "chunk_id", "score", "rank"]
    assert result.count() > 0
