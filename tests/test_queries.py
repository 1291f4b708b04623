"""Each query against its SQL, at the smallest scale."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as contract
from pairloom.plans.oracles import ORACLES
from pairloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    if not pathlib.Path(SF).exists():
        pytest.skip("no test data")
    db = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def in_order(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)


def test_every_query_of_the_library_has_its_sql():
    # merges are learned in many rounds: SQL cannot express that, test_subwords.py has a plain learner
    assert set(QUERIES) - set(ORACLES) == {"subword_merges"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_and_sql_agree(spark, database, name):
    df = contract.queries()[name](spark, SF)
    result = database.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, df.collect()) == in_order(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
