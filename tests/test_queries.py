"""Every registered query against its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from ledgerlark.plans import catalog  # noqa: F401
from ledgerlark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(frame, columns):
    def value(x):
        if not isinstance(x, list | tuple) and getattr(x, "ndim", 0) == 0 and pd.isna(x):
            return None
        try:
            return round(float(x), 9)
        except (TypeError, ValueError):
            return str(x)

    return sorted((tuple(value(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    own = QUERIES[name](spark, SF).toPandas()
    assert len(own)
    if name in ORACLES:
        other = con.execute(ORACLES[name]).fetchdf()
        columns = sorted(own.columns)
        assert columns == sorted(other.columns)
        assert plain(own, columns) == plain(other, columns)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_companies_beyond_the_first_parts_are_resolved(spark, tmp_path):
    spark.createDataFrame([(1, "some other thing"), (2000, "one more"), (2004, "late blue title"), (2005, "green")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(2004,), (2005,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["resolve_company"](spark, str(tmp_path)).collect()
    assert {r["mention_id"]: (r["ticker"], r["tier"]) for r in found} == {2004: ("P2004", 1), 2005: ("P2005", 2)}
