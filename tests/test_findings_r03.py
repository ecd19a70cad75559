"""What a review of larger tables found."""

from __future__ import annotations

import datetime
import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.operators import parsing, retrieval
from ledgerlark.plans import catalog  # noqa: F401
from ledgerlark.plans.registry import ORACLES, QUERIES


@pytest.fixture
def halves(spark, tmp_path):
    """Two files of rows of one supplier and year, whose sum depends on the order: 2**53 takes no single 1 but takes two at once."""
    day = datetime.datetime(1995, 5, 5)
    for part, prices in enumerate(([2.0**53], [1.0, 1.0])):
        rows = spark.createDataFrame([(7, day, p, 1.0) for p in prices], "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double")
        rows.coalesce(1).sortWithinPartitions("l_extendedprice").write.parquet(f"{tmp_path}/made/{part}")
    (tmp_path / "lineitem.parquet").mkdir()
    for part in range(2):
        next((tmp_path / "made" / str(part)).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{part}.parquet")
    return tmp_path


def _by_sql(folder, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return sorted(con.execute(ORACLES[name]).fetchall())


def test_enriched_rows_add_prices_in_the_order_of_rows(spark, halves):
    found = QUERIES["table_enrichment"](spark, str(halves)).select("sup", "yr", "position", "chunk_text", "token_count")
    assert [tuple(r) for r in found.collect()] == _by_sql(halves, "table_enrichment")


def test_split_tables_hold_sums_in_the_order_of_rows(spark, halves):
    found = QUERIES["table_split"](spark, str(halves)).select("sup", "position", "part_md5")
    assert sorted(map(tuple, found.collect())) == _by_sql(halves, "table_split")


def test_rows_of_small_sums_are_no_context(spark, tmp_path):
    rows = [(s, datetime.datetime(1990 + y, 5, 5), price, 1.0) for s in (3, 4) for y in range(12) for price in (1.0, [-3.0, 700.0, 90000.0][(y + s) % 3])]
    (tmp_path / "lineitem.parquet").mkdir()
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / "part-0.parquet")
    found = QUERIES["table_split"](spark, str(tmp_path)).select("sup", "position", "part_md5")
    assert sorted(map(tuple, found.collect())) == _by_sql(tmp_path, "table_split")


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """4,000 documents and 20 questions that share all their words: 80,000 pairs."""
    folder = tmp_path_factory.mktemp("alike")
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('the one word | of ', id % 7) AS text", "'en' AS lang", "'src0' AS source", "0L AS n_chars")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.range(20).selectExpr("id AS item_id", "'the word of one' AS text").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.range(20).selectExpr("id AS vec_id", "array(1f, CAST(id AS FLOAT)) AS embedding", "0 AS label").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def _rows_shuffled(spark, work):
    """Rows that the stages of the jobs run by work write to shuffles."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_sparse_ranks_as_all_scores_do(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, None if i % 11 == 0 else " ".join(["Apple", "pear", "", "fig fig", "İ9"][(i * k) % 5] for k in range(1, i % 13 + 1))) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, c string, text string").repartition(5)
    asked = spark.createDataFrame([(1, "apple FIG apple"), (2, "pear"), (3, ""), (4, None), (5, "nobody"), (6, "fig İ9 pear")], "query_id long, question string")
    targets = spark.createDataFrame([(1, "a"), (6, "b"), (6, "a"), (9, "a")], "query_id long, c string")
    every = retrieval.bm25(chunks, asked).join(chunks.select("chunk_id", "c"), "chunk_id")
    told = lambda df, *c: sorted(map(tuple, df.select("query_id", *c, "chunk_id", "score", "rank").collect()), key=repr)
    assert told(retrieval.sparse(chunks, asked, 7)) == told(retrieval.top(every, 7, ["query_id"]))
    assert told(retrieval.sparse(chunks, asked, 4, ["c"]), "c") == told(retrieval.top(every, 4, ["query_id", "c"]), "c")
    own = retrieval.top(every.join(targets, ["query_id", "c"], "left_semi"), 4, ["query_id", "c"])
    assert told(retrieval.sparse(chunks, asked, 4, ["c"], targets=targets), "c") == told(own, "c")
    assert retrieval.sparse(chunks.where("false"), asked, 4).count() == retrieval.sparse(chunks, asked.where("false"), 4).count() == 0


def test_pieces_and_blocks_change_nothing(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "a b c d"[: i % 8]) for i in range(200)], "chunk_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, "a b c d"[q % 7 :]) for q in range(20)], "query_id long, question string")
    once = sorted(map(tuple, retrieval.sparse(chunks, asked, 9).collect()))
    monkeypatch.setattr(retrieval, "QUESTION_BYTES", 500)
    assert sorted(map(tuple, retrieval.sparse(chunks, asked, 9).collect())) == once
    batch, told = pa.table({"chunk_id": range(200), "terms": [("a b c d"[: i % 8]).split() for i in range(200)]}), pa.table({"query_id": [0, 1]})
    args = batch, told, np.array([[0, 1, 2], [0, 0, 1]]), pa.array(["a", "b", "c"]), np.array([1.0, 2.0, 3.0]), 2.0, ["chunk_id"], 200, None
    best = lambda: sorted(r for b in retrieval._best_by_terms(*args) for r in map(tuple, pa.Table.from_batches([b]).to_pandas().values.tolist()))
    whole = best()
    monkeypatch.setattr(retrieval, "CELLS", 10)
    assert best() == whole and len(whole) > 200


# Queries that made a row for each pair of a question and a document.
PAIRS = [
    "contexts_and_citations", "refusal_retry", "retrieve", "diversity_quota", "first_seen_groups", "multi_pass_dedupe_cap40", "bm25_topk", "eval_summary", "hybrid_rrf", "rerank", "eval_context_recall", "context_budget",
]


@pytest.mark.parametrize("name", PAIRS)
def test_no_row_for_each_pair(spark, alike, name):
    assert _rows_shuffled(spark, lambda: QUERIES[name](spark, alike).collect()) < 40_000


def _passes(df, word):
    """How often the plan of df has a step with that word."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_statements_are_recovered_with_headings_found_once(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["statement_recovery"](spark, str(tmp_path))
    assert _passes(found, "posexplode") == 1  # the titles; headings come from a table
    assert found.collect() == []


def test_every_pattern_needs_one_of_the_words():
    for pattern, _, title in [*parsing.HEADINGS, *parsing.STATEMENTS]:
        assert any(w in pattern for w in parsing.WORDS), title


def test_short_documents_are_not_taken_apart_for_recovery(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, "item_7_mda", 2, 0, "Item 7: MD&A")], "doc_id long, section_id string, n_lines int, i int, title string")
    found = parsing.recovered(parsing.lines_of(docs), chosen)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("size(" in step and ">= 1000" in step for step in plan.splitlines()) and found.collect() == []
