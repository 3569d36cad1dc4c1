"""Every registered query with SQL gives the same rows on DuckDB, on the smallest scale."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from newsmood.plans import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    query = QUERIES[name]
    got = query.run(spark, FOLDER).toPandas()
    if query.sql is None:
        assert len(got.columns) > 0
        return
    expected = duck.execute(query.sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


def test_every_operator_has_a_query():
    covered = {c for q in QUERIES.values() for c in q.covers}
    wanted = {
        *(f"A{i}" for i in range(1, 12)), *(f"B{i}" for i in range(1, 11)), "C1", "C2", *(f"D{i}" for i in range(1, 10)),
        *(f"E{i}" for i in range(1, 6)), *(f"F{i}" for i in range(1, 13)), *(f"G{i}" for i in range(1, 10)),
        *(f"H{i}" for i in range(1, 13)), *(f"I{i}" for i in range(1, 14)), *(f"J{i}" for i in range(1, 17)),
        *(f"L{i}" for i in range(1, 23)), *(f"M{i}" for i in range(1, 6)), *(f"K{i}" for i in range(1, 5)),
    }
    assert wanted <= covered, sorted(wanted - covered)
