"""Every query of the registry against its SQL twin, in another engine."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from memloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def plain(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_its_twin(spark, sf, oracle, name):
    mine, twin = QUERIES[name](spark, sf).toPandas(), oracle.execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(twin.columns)
    assert plain(mine) == plain(twin)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_a_twin_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
