"""Every query with SQL gives the same rows, names and kinds of values as that SQL."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    found = Counter(tuple(plain(r[n]) for n in names) for r in got.collect())
    assert found == expected
    assert found, "no rows: the query shows nothing"
