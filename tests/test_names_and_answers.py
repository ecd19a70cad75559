"""Names and passages by their rarest part, ingestion and its store, requests on demand, and answers, against loops and small fixtures."""

from __future__ import annotations

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlark import ingestion
from ledgerlark.engine import Engine
from ledgerlark.operators import answering, context, indexing, lifecycle, matching, ondemand, parsing, routing
from ledgerlark.settings import Settings
from ledgerlark.sources import filings  # noqa: F401
from ledgerlark.streaming import ingest


def norm(s):
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split())


def test_names_resolve_as_a_loop_over_all_titles_would(spark):
    rng = random.Random(4)
    parts = ["exxon", "mobil", "blue", "sky", "3m", "general", "motors", "of", "a", "holdings", "ab", "bank"]
    titles = [(f"T{i}", rng.choice([" ", ", ", ""]).join(rng.choice(parts).title() for _ in range(rng.randint(1, 4))), i) for i in range(150)] + [("T900", "!!", 900), ("T901", None, 901), ("T902", "É", 902)] + [("T1000", "Exxon Mobil", 1000 + i) for i in range(40)]
    said = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(80)] + ["a", "b", "3M", "x", "", None, "?!", "T7", " t8 ", "exxonmobil", "The Exxon-Mobil Company", "zzz qqq", "a b"]
    said = said + said[:10]
    registry = spark.createDataFrame(titles, "ticker string, title string, ord int")
    got = {(r["mention_id"], r["ticker"], r["title"], r["tier"]) for r in routing.resolved(spark.createDataFrame(list(enumerate(said)), "mention_id int, mention string"), registry).collect()}
    want = set()
    for i, m in enumerate(said):
        best = []
        key, name = (m or "").strip().upper(), norm(m)
        exact = [(1, len(t or ""), o, k, t) for k, t, o in titles if m is not None and k.upper() == key]
        for k, t, o in [] if exact or not name else titles:
            n = norm(t)
            if n and (n in name or name in n):
                best.append((2, len(t), o, k, t))
            elif n and (n.replace(" ", "") in name.replace(" ", "") or name.replace(" ", "") in n.replace(" ", "")):
                best.append((3, len(t), o, k, t))
        tier, _, _, k, t = min(exact or best, default=(None,) * 5)
        want.add((i, k, t, tier))
    assert got == want


def test_candidates_need_no_nested_loop(spark):
    a, b = (spark.createDataFrame([(f"{x}{i} name of {i}",) * 2 for i in range(50)], "id string, text string") for x in "ab")
    plan = matching.candidates(a, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_passages_are_found_where_they_stand(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "x", "yy"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(5, "alpha beta"), (900, None), (901, "")]
    items = [(j, docs[j][1][rng.randint(0, 3) : rng.randint(4, 60)]) for j in range(40)] + [(77, "alpha"), (78, "pha be"), (79, ""), (80, None), (81, "no such words in any of them"), (82, "x"), (82, "x")]
    got = sorted((r["item_id"], r["doc_id"]) for r in matching.containing(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect())
    assert got == sorted((j, i) for j, t in items for i, d in docs if t is not None and d is not None and t in d)


def filler(n, word="Filler"):
    return "".join(f"<p>{word} paragraph number {i} says nothing of note at all.</p>\n" for i in range(n))


def table(label):
    return "<table><tr><td>Row</td><td>2024</td></tr>" + "".join(f"<tr><td>{label} part {i}</td><td>{29510 + i}</td></tr>" for i in range(8)) + "</table>"


def filing(*bodies, year=2024):
    parts = "".join(f"<DOCUMENT>\n<TYPE>{kind}\n<TEXT>\n<html><body>{body}</body></html>\n</TEXT>\n</DOCUMENT>\n" for kind, body in bodies)
    return f"{'HEADER LINE' * 4000}\nCONFORMED PERIOD OF REPORT:\t{year}0928\n{parts}"


WRAPPER = filler(20) + "<p>Item 5. Market for equity</p>" + filler(20) + "<p>Item 10. Directors</p>" + filler(20) + table("Wrapper")
EXHIBIT = filler(20, "Exhibit") + "<p>Item 1A. Risk Factors</p><p>Many risks may harm our revenue in every market.</p>" + filler(20) + table("Exhibit") + "<p>Item 7. Management's Discussion</p>" + filler(20) + "<p>Item 5. Market for equity</p>" + filler(20)


def put(root, ticker, accession, text, details=None):
    folder = root / "raw" / ticker / "10-K" / accession
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "full-submission.txt").write_text(text)
    if details:
        (folder / "filing-details.json").write_text(details)
    return folder / "full-submission.txt"


def test_sections_of_exhibits_are_found_and_ids_and_tables_numbered_through(spark):
    docs = spark.createDataFrame([("d", f"<!-- ===== embedded document: 10-K ===== -->{WRAPPER}<!-- ===== embedded document: EX-13 ===== -->{EXHIBIT}"), ("none", filler(5)), ("blank", " "), ("null", None)], "doc_id string, html string")
    sections, tables, bad = ingestion.parsed(docs)
    found = {(r["doc_id"], r["section_id"]): r["body"] for r in sections.collect()}
    assert {s for d, s in found if d == "d"} == {"item_5_market", "item_governance", "item_1a_risk_factors", "item_7_mda"} | ({"item_5_market__2"} if ("d", "item_5_market__2") in found else set())
    assert "Many risks" in found["d", "item_1a_risk_factors"] and "Exhibit paragraph number 3" in found["d", "item_governance"]
    assert ("none", "full_document") in found
    assert {(r["doc_id"], r["idx"]): "Wrapper" in r["markdown"] for r in tables.collect()} == {("d", 0): True, ("d", 1): False}
    assert "<<<TABLE_1>>>" in found["d", "item_1a_risk_factors"] and "<<<TABLE_0>>>" in found["d", "item_governance"]
    assert {r["doc_id"]: r["error"] for r in bad.collect()} == {"blank": ingestion.NO_REPORT, "null": ingestion.NO_REPORT}


def test_filings_are_parsed_once_and_failures_are_listed(spark, tmp_path):
    settings = Settings(raw_dir=str(tmp_path / "raw"), parsed_dir=str(tmp_path / "parsed"), index_dir=str(tmp_path / "index"))
    first = put(tmp_path, "AAPL", "0000320193-24-000123", filing(("10-K", WRAPPER), ("EX-13", EXHIBIT)))
    put(tmp_path, "MSFT", "0000320193-24-000200", filing(("10-K", EXHIBIT), year=2023))
    put(tmp_path, "EMPT", "0000320193-24-000300", filing(("EX-99", WRAPPER)))
    put(tmp_path, "JPM", "0000320193-22-000001", "no header\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>" + EXHIBIT + "</TEXT></DOCUMENT>", '{"reportDate": "2021-12-31"}')
    put(tmp_path, "BAD", "0000320193-24-000400", filing(("10-K", EXHIBIT), ("EX-13", "<![x[ no such section")))
    made = sorted((r["ticker"], r["fiscal_year"]) for r in ingestion.run(spark, settings).collect())
    errors = {r["doc_id"]: (r["stage"], r["error"]) for r in ingestion.dead_letters(spark, settings).collect()}
    assert errors["EMPT_2024"] == ("parse", ingestion.NO_REPORT)
    assert errors["BAD_2024"][0] == "parse" and errors["BAD_2024"][1].startswith("AssertionError") and set(errors) == {"BAD_2024", "EMPT_2024"}
    assert made == [("AAPL", 2024), ("JPM", 2021), ("MSFT", 2023)]
    chunks = spark.read.parquet(f"{settings.index_dir}/chunks")
    assert {"item_1a_risk_factors", "item_5_market"} <= {r["section_id"] for r in chunks.where("ticker = 'AAPL'").select("section_id").distinct().collect()}
    assert ingestion.parse(spark, settings) == 0 and ingestion.run(spark, settings).count() == 0
    os.utime(first, (time.time() + 60,) * 2)  # touched, but the same
    assert ingestion.parse(spark, settings) == 0
    first.write_text(filing(("10-K", EXHIBIT)) + " ")
    os.utime(first, (time.time() + 120,) * 2)
    assert [(r["ticker"], r["fiscal_year"]) for r in ingestion.run(spark, settings).collect()] == [("AAPL", 2024)]
    assert ingestion.manifest(spark, settings).where("doc_id = 'AAPL_2024'").first()["tables"] == 1


def test_a_page_that_fails_does_not_touch_the_others(spark):
    pages = spark.createDataFrame([(1, "<p>good</p>"), (2, "<![x[ bad"), (3, None)], "doc_id int, html string").coalesce(1)
    rows = {r["doc_id"]: r for r in parsing.extract_tables(pages).collect()}
    assert "good" in rows[1]["text"] and rows[1]["error"] is None and rows[3]["text"] == "" and rows[2]["text"] is None and rows[2]["error"].startswith("AssertionError")


def test_a_model_finds_headings_that_the_patterns_miss(spark):
    lines = [f"Line {i}" for i in range(300)]
    lines[120], lines[200] = "What we earned this year", "Changes in what owners hold"
    text = "\n".join(lines)

    def model(pages, wanted):
        if any("Line 299" in p for p in pages):
            raise ValueError("no more")
        return [{s: h for s, h in (("fs_income_stmt", "what we EARNED"), ("fs_equity", "Changes in what owners"), ("fs_notes", "not there at all")) if "earned" in p} for p in pages]

    docs = spark.createDataFrame([(1, text), (2, "short\n" * 10)], "doc_id int, text string")
    found = {(r["doc_id"], r["section_id"]): r["body"] for r in parsing.sections_of(docs, recover=parsing.by_model(model)).collect()}
    assert set(found) == {(1, "fs_income_stmt"), (2, "full_document")} and found[1, "fs_income_stmt"].startswith("Line 121\n")
    assert {r["section_id"] for r in parsing.sections_of(docs).collect()} == {"full_document"}


EVENTS = "event_id long, ticker string, year int, ts timestamp, kind string, years array<int>"


def some_events(seed, n=400):
    rng = random.Random(seed)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["A", "B", "C", "HOT", "HOT", "HOT"]), rng.choice([None, 2022, 2023, 2024]), begin + datetime.timedelta(seconds=rng.randrange(4000), milliseconds=rng.choice([0, 0, 250])), "request" if rng.random() < 0.85 else "result", rng.choice([None, [], [2023], [2023, 2024]])) for i in range(n)]
    return rows


def outcomes_of(rows, ttl=300):
    out, state = {}, {}
    for i, ticker, year, ts, kind, years in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[3], r[4] == "request", r[0])):
        s = state.setdefault(ticker, {"have": set(), "failed": None, "pending": None, "no": {}})
        fresh = lambda t, ts=ts: t is not None and (ts - t).total_seconds() < ttl
        if kind != "request":
            s["pending"] = None
            if years:
                s["have"] |= set(years)
                s["failed"] = None
                if year is not None and year not in years:
                    s["no"][year] = ts
            else:
                s["failed"] = ts
        elif (year in s["have"]) or (year is None and s["have"]):
            out[i] = ("indexed", year or max(s["have"]))
        elif year is not None and fresh(s["no"].get(year)):
            out[i] = ("year_not_available", None)
        elif fresh(s["failed"]):
            out[i] = ("failed", None)
        elif fresh(s["pending"]):
            out[i] = ("waiting", None)
        else:
            s["pending"], out[i] = ts, ("fetch", None)
    return out


def test_requests_are_decided_as_a_loop_would(spark):
    rows = some_events(1) + [(9000, None, 2023, datetime.datetime(2024, 1, 1), "request", None), (9001, "A", None, None, "request", None)]
    got = {r["event_id"]: (r["outcome"], r["served_year"]) for r in ondemand.decided(spark.createDataFrame(rows, EVENTS).repartition(5)).collect()}
    assert got == outcomes_of(rows) and {o for o, _ in got.values()} == {"indexed", "year_not_available", "failed", "waiting", "fetch"}
    assert ondemand.decided(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_stream_of_requests_remembers_failures_until_they_expire(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(some_events(2, 150), key=lambda r: r[3])
    at = rows[-1][3]
    rows += [(1001, "Z", None, at, "request", None), (1002, "Z", None, at + datetime.timedelta(seconds=1), "result", None), (1003, "Z", None, at + datetime.timedelta(seconds=100), "request", None), (1004, "Z", None, at + datetime.timedelta(seconds=400), "request", None)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    q = ingest.decisions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    got = {r["event_id"]: (r["outcome"], r["served_year"]) for r in spark.read.parquet(out).collect()}
    batch = {r["event_id"]: (r["outcome"], r["served_year"]) for r in ondemand.decided(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == batch == outcomes_of(rows) and [got[i][0] for i in (1001, 1003, 1004)] == ["fetch", "failed", "fetch"]


def test_memories_expire():
    known = ondemand.Known(pending=5, failed=10, missing={2023: 20, 2024: 400_000_000})
    known.expire(300_000_010)
    assert known.pending is None and known.failed is None and known.missing == {2023: 20, 2024: 400_000_000}


def test_companies_are_fetched_on_demand_and_failures_are_not_tried_again(spark, tmp_path):
    settings = Settings(raw_dir=str(tmp_path / "raw"), parsed_dir=str(tmp_path / "parsed"), index_dir=str(tmp_path / "index"))
    put(tmp_path, "AAPL", "0000320193-24-000123", filing(("10-K", EXHIBIT)))
    asked = spark.createDataFrame([("aapl", 2024), ("AAPL", 2019), ("AAPL", None), ("NONE", None)], "ticker string, year int")
    out = {(r["ticker"], r["year"]): (r["outcome"], r["years"]) for r in ingestion.on_demand(spark, settings, asked).collect()}
    assert out == {("AAPL", 2024): ("fetched", [2024]), ("AAPL", 2019): ("year_not_available", [2024]), ("AAPL", None): ("fetched", [2024]), ("NONE", None): ("failed", [])}
    tried = []
    real = ingestion.parse
    try:
        ingestion.parse = lambda *a, **b: tried.append(a[3]) or real(*a, **b)
        again = {(r["ticker"], r["year"]): r["outcome"] for r in ingestion.on_demand(spark, settings, asked).collect()}
    finally:
        ingestion.parse = real
    assert again == {("AAPL", 2024): "indexed", ("AAPL", 2019): "year_not_available", ("AAPL", None): "indexed", ("NONE", None): "failed"} and tried == []
    past = spark.read.parquet(f"{settings.index_dir}/failures")
    assert {(r["ticker"], r["year"]) for r in past.collect()} == {("AAPL", 2019), ("NONE", None)}


CHUNKS = "chunk_id string, text string, company string, ticker string, fiscal_year int, section_id string, section_name string, chunk_type string, position int"


def engine_of(spark, **more):
    rows = []
    for t, n, _ in routing.COMPANIES[:3]:
        for y in (2023, 2024):
            rows += [(f"{t}{y}{i}", f"{n} total revenue grew in {y}. Part {i}.", n, t, y, s, s, "text", i) for i, s in enumerate(["item_1_business", "fs_income_stmt", "item_7_mda"])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    parents = chunks.select("ticker", "fiscal_year", "section_id", F.col("text").alias("parent_text"))
    return Engine(chunks, indexing.hashed(chunks).select("chunk_id", "dense"), parents, routing.companies(spark), **more)


def asking(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions, 1)), "query_id int, question string")


def test_answers_of_several_companies_are_put_together(spark):
    asked = asking(spark, "Compare Apple and Microsoft revenue in 2023 and 2024", "How did Apple revenue change in 2023 and 2024?", "Compare Apple and SpaceX revenue in 2024", "What was the revenue of SpaceX?", "What was Amazon.com revenue in 2024?", "What was Apple revenue in 2025?", "what is the weather?")
    out = {r["query_id"]: r for r in engine_of(spark).ask(asked).collect()}
    one = out[1]
    assert one["route"] == "synthesis" and [c["index"] for c in one["citations"]] == list(range(1, len(one["citations"]) + 1)) and all(f"[{c['index']}]" in one["answer"] for c in one["citations"])
    assert {(c["ticker"], c["fiscal_year"]) for c in one["citations"]} == {(t, y) for t in ("AAPL", "MSFT") for y in (2023, 2024)} and "### AAPL FY2023" in one["answer"]
    assert "What was Apple Inc.'s total net sales or total revenue in fiscal year 2023?" in out[2]["answer"]
    assert out[3]["failed_lookups"] == ["SpaceX"] and "*Note:" in out[3]["answer"] and {c["ticker"] for c in out[3]["citations"]} == {"AAPL"}
    assert out[4]["route"] == "unresolved_company" and "SpaceX" in out[4]["answer"] and out[4]["citations"] is None
    assert out[5]["route"] == "unresolved_company" and out[5]["ingest_failed"] == ["AMZN"]
    assert out[6]["year_not_available"] == ["AAPL (asked for FY2025, have FY2023/FY2024)"]
    assert out[7]["route"] == "out_of_scope" and out[7]["answer"] == answering.OUT_OF_SCOPE


def test_a_synthesis_that_fails_falls_back_to_the_sub_answers(spark):
    def model(question, text):
        if "Microsoft" in question:
            raise ValueError("busy")
        return "Both grew [1]."

    asked = asking(spark, "Compare Apple and Microsoft revenue in 2024", "Compare Apple and Google revenue in 2024", "Compare Apple and Alphabet revenue in 2024")
    out = {r["query_id"]: r["answer"] for r in engine_of(spark, write=answering.by_model(model)).ask(asked).collect()}
    assert out[1].startswith("### AAPL FY2024") and out[3] == "Both grew [1]."


def test_refusals_are_asked_once_more_and_wider(spark):
    calls = []

    def answer(sources):
        n = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        calls.append({r["query_id"]: r["n"] for r in n.collect()})
        return n.select("query_id", F.when((F.col("query_id") == 1) | (F.col("n") < 4) & (F.col("query_id") == 2), "It cannot be found.").otherwise("Said [1].").alias("answer"))

    chunks = [(f"c{i}", f"Apple revenue item {i}", "Apple Inc.", "AAPL", 2024, f"s{i}", f"s{i}", "text", i) for i in range(12)]
    rows = spark.createDataFrame(chunks, CHUNKS)
    engine = Engine(rows, indexing.hashed(rows).select("chunk_id", "dense"), rows.select("ticker", "fiscal_year", "section_id", F.col("text").alias("parent_text")), routing.companies(spark), answer=answer)
    out = {r["query_id"]: (r["answer"], r["refused"], r["retried"], r["mended"]) for r in engine.ask(asking(spark, *["What was Apple revenue in 2024?"] * 3)).collect()}
    assert out == {1: ("It cannot be found.", True, True, False), 2: ("Said [1].", False, True, True), 3: ("Said [1].", False, False, False)}
    asked = [c for c in calls if c]
    assert [set(c) for c in asked] == [{1, 2, 3}, {1, 2}] and max(asked[0].values()) == 3 and max(asked[1].values()) == 6


def test_earlier_turns_of_a_session_go_before_its_question(spark):
    turns = spark.createDataFrame([("t1", "s1", "What was Apple revenue in 2024?", "It grew.", 1)], "id string, session_id string, question string, answer string, created_at int")
    asked = spark.createDataFrame([(1, "s1", "And the year before?"), (2, "s2", "And the year before?")], "query_id int, session_id string, question string")
    out = {r["query_id"]: r for r in engine_of(spark).ask(asked, turns).collect()}
    assert out[1]["route"] == "single" and {c["ticker"] for c in out[1]["citations"]} == {"AAPL"} and out[2]["route"] == "out_of_scope"


def test_questions_fetch_companies_that_are_not_indexed(spark):
    asked = []

    def fetch(rows):
        asked.extend((r["ticker"], r["year"]) for r in rows.collect())
        return rows.select("ticker", "year", F.when(F.col("ticker") == "JPM", F.array(F.lit(2024))).alias("years"))

    have = spark.createDataFrame([("AAPL", 2023)], "ticker string, fiscal_year int")
    rows = spark.createDataFrame([(1, "single_doc", ["AAPL", "JPM", "GS"], [2024], "revenue", []), (2, "out_of_scope", ["AAPL"], [], "other", []), (3, "single_doc", [], [], "other", [])], "query_id int, query_type string, tickers array<string>, years array<int>, focus string, unresolved array<string>")
    registry = spark.createDataFrame([("X", "Some Title", 0)], "ticker string, title string, ord int")
    out = {r["query_id"]: r for r in routing.ensured(rows, registry, routing.companies(spark), have, fetch).collect()}
    assert sorted(asked) == [("AAPL", 2024), ("GS", 2024), ("JPM", 2024)]
    assert out[1]["tickers"] == ["JPM"] and sorted(out[1]["ingest_failed"]) == ["AAPL", "GS"] and [tuple(t) for t in out[1]["targets"]] == [("JPM", 2024)]
    assert out[2]["query_type"] == "single_doc" and out[2]["route"] == "single" and [tuple(t) for t in out[2]["targets"]] == [("AAPL", 2023)]
    assert out[3]["route"] == "clarification_needed"


def test_a_cache_of_failures_equals_a_loop(spark):
    rng = random.Random(3)
    begin = datetime.datetime(2024, 1, 1)
    some = lambda n, k: [(k + i, rng.choice(["a", "b", None]), begin + datetime.timedelta(seconds=rng.randrange(3000))) for i in range(n)]
    asked, failed = some(200, 0) + [(500, "a", None)], some(15, 1000) + [(1100, "a", None)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, k string, ts timestamp")
    got = sorted(r["id"] for r in lifecycle.not_cached(frame(asked), frame(failed), ["k"]).collect())
    free = lambda k, t: k is None or t is None or not any(k == q and f is not None and 0 <= (t - f).total_seconds() < 300 for _, q, f in failed)
    assert got == sorted(i for i, k, t in asked if free(k, t))
    assert context.NO_SOURCES
