"""Every registered query of the library agrees with its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    if sql := entry.oracle_sql().get(name):
        db = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        result = db.execute(sql)
        at = [[c[0] for c in result.description].index(c) for c in columns]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    else:
        assert rows
