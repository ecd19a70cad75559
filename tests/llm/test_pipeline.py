"""The stages one by one on their own inputs, and the registered queries against their SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import queries as own
from ledgerlark.llm.common import saved

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert total.where("n <> all").count() == 0 and total.count() == docs.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = own.QUERIES[name](spark, SF).toPandas(), con.execute(own.ORACLES[name]).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda d: sorted(map(repr, (tuple(None if x != x or x is None else float(x) if not isinstance(x, str) else x for x in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))))
    assert plain(a) == plain(b)
