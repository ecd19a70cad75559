"""Points of an index: upserts, deletions, compaction, clustered files, sizes; encoders held by workers; registry snapshots."""

from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import indexing, points
from ledgerlark.operators.lifecycle import store_partitions
from ledgerlark.sources import filings

SCHEMA = "ticker string, fiscal_year int, chunk_id string, section_name string, chunk_type string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, path):
    return points.Points(str(path), table(spark, []).schema)


def held(store, spark):
    return Counter(tuple(r) for r in store.rows(spark).collect())


def point(ticker, year, ident, text, section="Risk", kind="text"):
    return (ticker, year, ident, section, kind, text)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_deletions_and_compaction_give_the_same_rows(spark, tmp_path):
    s = store(spark, tmp_path / "p")
    assert not held(s, spark) and s.compact(spark) == 0
    base = [point("007", 2023, str(i), f"a{i}") for i in range(5)] + [point("B", 2023, str(i), f"b{i}") for i in range(5)] + [point("C", 2024, "0", "c0"), point(None, None, None, "n")]
    s.replace(table(spark, base))
    assert held(s, spark) == Counter(base)  # a ticker that looks like a number stays text
    s.put(table(spark, [point("007", 2023, "1", "new"), point("D", 2025, "9", "d9"), point(None, None, None, "m")]))
    s.remove(table(spark, [point("C", 2024, "0", ""), point("007", 2023, "2", ""), point("B", 2024, "0", "")]).drop("text"))
    s.put(table(spark, [point("007", 2023, "2", "again")]))
    want = {(r[0], r[1], r[2]): r for r in base}
    want.update({("007", 2023, "1"): point("007", 2023, "1", "new"), ("D", 2025, "9"): point("D", 2025, "9", "d9"), (None, None, None): point(None, None, None, "m"), ("007", 2023, "2"): point("007", 2023, "2", "again")})
    del want["C", 2024, "0"]
    want = Counter(want.values())
    assert held(s, spark) == want
    before = files(tmp_path / "p" / "base")
    assert s.compact(spark) == 5  # 007, D, C, the null collection, and (B, 2024), which never held a point
    after = files(tmp_path / "p" / "base")
    assert held(s, spark) == want and not os.path.exists(tmp_path / "p" / "deltas")
    assert {f: t for f, t in before.items() if "ticker=B" in f} == {f: t for f, t in after.items() if "ticker=B" in f}
    assert not any("ticker=C" in f for f in after)
    s.put(table(spark, [point("007", 2023, "1", "new")]))  # the same again
    assert held(s, spark) == want and s.compact(spark) == 1 and held(s, spark) == want


def test_a_compaction_that_ended_early_is_repeated(spark, tmp_path):
    s = store(spark, tmp_path / "p")
    s.replace(table(spark, [point("A", 2023, "0", "x"), point("B", 2023, "0", "y")]))
    s.put(table(spark, [point("A", 2023, "0", "z"), point("A", 2023, "1", "w")]))
    s.remove(table(spark, [point("B", 2023, "0", "")]))
    want, rows = held(s, spark), [tuple(r) for r in s.rows(spark).collect()]
    s.replace(table(spark, rows))  # the files are written, the deltas are still there
    assert held(s, spark) == want and s.compact(spark) == 2 and held(s, spark) == want


def test_a_batch_that_ended_early_does_not_count(spark, tmp_path):
    s = store(spark, tmp_path / "p")
    s.replace(table(spark, [point("A", 2023, "0", "x"), point("A", 2023, "1", "y")]))
    s.put(table(spark, [point("A", 2023, "0", "z")]))
    want = held(s, spark)
    table(spark, [point("A", 2023, "1", "w")]).select("ticker", "fiscal_year", "chunk_id").write.parquet(str(tmp_path / "p" / "ids" / "_load=2"))
    os.makedirs(tmp_path / "p" / "deltas" / "_load=2" / "_temporary")
    assert held(s, spark) == want
    s.put(table(spark, [point("A", 2023, "0", "v")]))
    assert held(s, spark) == Counter([point("A", 2023, "0", "v"), point("A", 2023, "1", "y")])


def test_few_deltas_go_to_the_files_and_not_the_files_to_them(spark, tmp_path):
    s = store(spark, tmp_path / "p")
    s.replace(table(spark, [point("A", 2023, str(i), "x") for i in range(100)]))
    s.put(table(spark, [point("A", 2023, "0", "z")]))
    plan = s.rows(spark)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_of_equal_ids_in_a_batch_the_last_stays(spark, tmp_path):
    s = store(spark, tmp_path / "p")
    batch = table(spark, [point("A", 2023, "0", t) for t in ("first", "third", "second")]).withColumn("at", F.element_at(F.create_map(F.lit("first"), F.lit(1), F.lit("second"), F.lit(2), F.lit("third"), F.lit(3)), F.col("text")))
    s.put(batch, "at")
    assert [r["text"] for r in s.rows(spark).collect()] == ["third"]
    s.put(table(spark, [point("A", 2023, "1", "same")] * 3))
    assert s.rows(spark).count() == 2


def test_a_collection_of_most_rows_is_written_by_many_tasks_and_sections_skip_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit("A").alias("ticker"), F.lit(2023).alias("fiscal_year"), F.col("id").cast("string").alias("chunk_id"), F.format_string("s%02d", F.col("id") % 40).alias("section_name"), F.lit("text").alias("chunk_type"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    keys, path = ["ticker", "fiscal_year"], str(tmp_path / "c")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store_partitions(rows, path, keys, ["section_name", "chunk_type", "chunk_id"], ["chunk_id"])
        store_partitions(rows, str(tmp_path / "plain"), keys)
        assert len(files(path)) == 8 and len(files(tmp_path / "plain")) == 1

        def read(where, folder):
            df = spark.read.parquet(folder).where(where)
            df.collect()
            plan = df._jdf.queryExecution().executedPlan()
            leaves = plan.collectLeaves()
            return leaves.apply(0).metrics().apply("numOutputRows").value()

        assert read("section_name = 's07'", path) <= 10_000 and read("section_name = 's07'", str(tmp_path / "plain")) == 40_000
        assert spark.read.parquet(path).where("section_name = 's07'").count() == 1000
        assert read("chunk_id = '12345x'", path) < 40_000  # Bloom filters
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_sizes_are_those_of_the_files(spark, tmp_path):
    s = store(spark, tmp_path / "p")
    assert points.sizes(spark, str(tmp_path / "none")).count() == 0
    s.replace(table(spark, [point("A b", 2023, "0", "x" * 1000), point("B", 2023, "0", "y")]))
    own = {f: os.path.getsize(f) for f in files(tmp_path / "p")}
    assert [tuple(r) for r in points.sizes(spark, str(tmp_path / "p")).collect()] == [(".", 2, sum(own.values()))]
    found = {r["folder"]: r["bytes"] for r in points.sizes(spark, str(tmp_path / "p" / "base"), 1).collect()}
    assert found == {f"ticker={t}": sum(n for f, n in own.items() if f"ticker={t}/" in f) for t in ("A b", "B")}


def test_counts_of_sections_and_types(spark):
    rows = table(spark, [point("A", 1, "0", "x", "s"), point("A", 1, "1", " ", "s", "table"), point("A", 1, "2", None, None), point("B", 1, "0", "z", "t", None)])
    found = {r["ticker"]: tuple(r)[1:] for r in points.counted(rows, ["ticker"], "section_name").collect()}
    assert found == {"A": (3, 1, 1, 2, 1), "B": (1, 1, 0, 0, 1)}


def test_models_are_loaded_once_in_a_worker_and_know_their_mode(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts, mode: [[len(t), os.getpid() % 1000, mode == "query", len(texts)] for t in texts]

    rows = spark.range(40).repartition(20).select("id", F.when(F.col("id") > 0, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("text"), F.lit("old").alias("dense"))
    for mode in ("passage", "query"):
        found = indexing.encoded(rows, load, "lengths-1", mode=mode, batch=3).collect()
        assert {r["id"]: r["dense"][0] for r in found} == {i: float(i) for i in range(40)}
        assert all(r["dense"][2] == (mode == "query") and r["dense"][3] <= 3 for r in found)
    assert all(open(f"{folder}/{n}").read() == "x" for n in os.listdir(folder))  # 40 tasks, each process loads once
    with pytest.raises(ValueError):
        indexing.encoded(rows, load, "lengths-1", mode="other")


def test_registry_snapshots(spark, tmp_path):
    source, cache, day = str(tmp_path / "r.json"), str(tmp_path / "cache"), 86400.0

    def put(title):
        with open(source, "w") as f:
            json.dump({"0": {"cik_str": 7, "ticker": "aa", "title": "old"}, "1": {"cik_str": 7, "ticker": "AA", "title": title}, "2": {"cik_str": 9, "ticker": "", "title": "none"}}, f)

    def titles(at):
        return [(r["ticker"], r["title"], r["cik"]) for r in filings.kept_registry(spark, source, cache, at).collect()]

    assert titles(0) == []  # neither source nor snapshot
    put("one")
    assert titles(day) == [("AA", "one", "0000000007")]
    put("two")
    assert titles(day * 7.9) == [("AA", "one", "0000000007")]  # young enough
    assert titles(day * 8.1) == [("AA", "two", "0000000007")] and len(os.listdir(cache)) == 1
    for broken in ("not json", "{}"):
        with open(source, "w") as f:
            f.write(broken)
        assert titles(day * 30) == [("AA", "two", "0000000007")]
    os.remove(source)
    assert titles(day * 60) == [("AA", "two", "0000000007")]
