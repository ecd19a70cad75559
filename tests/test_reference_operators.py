"""Operators against plain loops with random inputs, and worked examples."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.engine import Engine
from ledgerlark.functions import text as X
from ledgerlark.operators import chunking, context, indexing, lifecycle, parsing, retrieval, routing, sessions
from ledgerlark.sources import filings
from ledgerlark.streaming import ingest


def tokens(s):
    return len(re.findall(r"\w+|[^\w\s]", s, re.ASCII))


def pack_loop(sentences, most, overlap):
    out, cur, n = [], [], 0
    for s in sentences:
        t = tokens(s)
        if t > most:
            if cur:
                out.append(" ".join(cur))
            out.append(s)
            cur, n = [], 0
            continue
        if cur and n + t > most:
            out.append(" ".join(cur))
            cur = cur[-overlap:] if overlap else []
            n = sum(map(tokens, cur))
        cur.append(s)
        n += t
    return [x for x in out + ([" ".join(cur)] if cur else []) if x.strip()]


@pytest.mark.parametrize(("most", "overlap"), [(20, 2), (8, 1), (50, 0)])
def test_sentence_packing_equals_a_loop(spark, most, overlap):
    rng = random.Random(1)
    docs = [[" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 25))] for _ in range(150)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, s array<string>")
    got = {r["i"]: r["c"] for r in rows.select("i", chunking.packed(F.col("s"), most, overlap).alias("c")).collect()}
    assert all(got[i] == pack_loop(d, most, overlap) for i, d in enumerate(docs))


def table_loop(text, most):
    if tokens(text) <= most:
        return [text]
    lines = text.strip(" ").split("\n")
    if len(lines) < 3:
        return [text]
    head, rows, lead = lines[:2], lines[2:], 0
    for r in rows[:8]:
        if any(re.match(r"^\d{5,}$|^\d{1,3}(?:,\d{3}){2,}$", c.strip()) for c in r.split("|")):
            break
        lead += 1
    fixed, left = head + rows[:lead], rows[lead:]
    if not left:
        return [text]
    per = max(1, tokens("\n".join(left[:10])) // min(10, len(left)))
    step = max(1, (most - tokens("\n".join(fixed) + "\n")) // per)
    return ["\n".join(fixed + left[i : i + step]) for i in range(0, len(left), step)]


def test_table_parts_equal_a_loop(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(150):
        rows = ["| " + " | ".join(rng.choice(["Year 2024", "12345", "1,234,567", "391,035", "x", ""]) for _ in range(3)) + " |" for _ in range(rng.randint(0, 30))]
        texts.append("\n".join(["| A | B | C |", "| --- | --- | --- |"][: rng.choice([2, 2, 1])] + rows))
    got = {r["i"]: r["p"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.table_parts(F.col("t"), 60).alias("p")).collect()}
    assert all(got[i] == table_loop(t, 60) for i, t in enumerate(texts))


def test_monotonic_order_equals_a_loop(spark):
    rng = random.Random(3)
    ids = [*parsing.PRIORITY, "item_x"]
    rows = [(d, i, rng.choice(ids), "t", 100) for d in range(80) for i in sorted(rng.sample(range(100), rng.randint(1, 15)))]
    got = {(r["doc_id"], r["i"]) for r in parsing.monotonic(spark.createDataFrame(rows, "doc_id int, i int, section_id string, title string, n_lines int")).collect()}
    expected, top = set(), {}
    for d, i, s, *_ in rows:
        p = parsing.PRIORITY.get(s, 500)
        if s.startswith("fs_") or p > top.get(d, -1):
            expected.add((d, i))
            if not s.startswith("fs_"):
                top[d] = p
    assert got == expected


def test_quota_and_budget_equal_loops(spark):
    rng = random.Random(4)
    rows = [(q, c, rng.choice("ab"), round(rng.random(), 1), rng.randint(0, 40)) for q in range(40) for c in range(30)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, g string, score double, tokens int")
    got = {q: set() for q in range(40)}
    for r in retrieval.diverse(df, ["g"], 5, 3).collect():
        got[r["query_id"]].add(r["chunk_id"])
    ranked = df.withColumn("rank", F.col("chunk_id"))
    fits = {(r["query_id"], r["chunk_id"]) for r in context.within_budget(ranked, most=100).collect()}
    for q in range(40):
        own, taken, kept = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1])), {}, []
        for r in own:
            if len(kept) < 5 and taken.get(r[2], 0) < 3:
                taken[r[2]] = taken.get(r[2], 0) + 1
                kept.append(r[1])
        assert got[q] == set(kept)
        total, inside = 0, set()
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            if inside and total + r[4] > 100:
                break
            total += r[4]
            inside.add((q, r[1]))
        assert {x for x in fits if x[0] == q} == inside


def test_noise(spark):
    table = "Apple (AAPL) FY2024 — Income\n| Row | Row | 2024 |\n| --- | --- | --- |\n| Services | Services | 96 | | |\n| Total net sales | Total net sales | 391 | |"
    got = spark.createDataFrame([(table,)], "t string").select(X.without_noise("t").alias("t")).first()["t"].split("\n")
    assert got[:2] == ["Apple (AAPL) FY2024 — Income", "| Row | 2024 |"] and got[2].startswith("| Total net sales | 391") and got[3] == "| --- | --- | --- |"


def test_renumbering_never_takes_a_new_number_for_an_old_one(spark):
    df = spark.createDataFrame([("[1] and [2], [3]",)], "a string")
    assert df.select(context.renumbered(F.col("a"), F.lit(2)).alias("a")).first()["a"] == "[3] and [4], [5]"


def test_tables_of_pages(spark):
    html = (
        "<html><head><title>x</title></head><p>Intro</p><table><tr><td>Consolidated Balance Sheets</td><td></td></tr><tr><td>Cash and cash equivalents of the company</td><td>29,510</td></tr>"
        "<tr><td>Total assets and everything else held</td><td>27,195</td></tr></table><table><tr><td>Item 1.</td><td>Business</td></tr></table><p>End</p>"
    )
    r = parsing.extract_tables(spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")).orderBy("doc_id").collect()
    assert "FS_SECTION_HEADER:Consolidated Balance Sheets" in r[0]["text"] and "<<<TABLE_0>>>" in r[0]["text"] and "FS_SECTION_HEADER:Item 1: Business" in r[0]["text"]
    assert "<<<TABLE_1>>>" not in r[0]["text"] and len(r[0]["tables"]) == 1 and r[0]["tables"][0]["rows"][1][1] == "29,510" and r[1]["tables"] == []


def test_sections_of_a_filing(spark):
    lines = ["Cover"] * 30 + ["Item 1.", "", "Business", "We sell things to people in many countries."] + ["filler line"] * 60 + ["Item 1A. Risk Factors", "Many risks exist."] + ["filler"] * 50 + ["See Item 1. Business above", "Item 7. Management's Discussion", "Text."] + ["more"] * 60
    text = "\n".join(lines)
    out = parsing.sections_of(spark.createDataFrame([(1, text), (2, "no headings here")], "doc_id long, text string")).orderBy("doc_id", "section_order").collect()
    assert [r["section_id"] for r in out] == ["item_1_business", "item_1a_risk_factors", "item_7_mda", "full_document"]
    assert out[0]["body"].startswith("\nBusiness") and out[1]["body"].startswith("Many risks") and out[3]["body"] == "no headings here"


def test_submission_and_registry(spark, tmp_path):
    (tmp_path / "full-submission.txt").write_text("<SEC>\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>\n<XBRL>main</XBRL>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>GRAPHIC\n<TEXT>x</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-13.1\n<TEXT>annual</TEXT>\n</DOCUMENT>")
    html = filings.joined(filings.documents_of(filings.submissions(spark, str(tmp_path)))).first()["html"]
    assert "main" in html and "annual" in html and "GRAPHIC" not in html and spark.createDataFrame([(html,)], "html string").transform(parsing.documents_of).count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "t.json").write_text('{"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple Inc."}, "1": {"cik_str": 34088, "ticker": "XOM", "title": "ExxonMobil Holdings Corp"}}')
    reg = filings.registry(spark, str(tmp_path / "r"))
    assert reg.where("ticker = 'AAPL'").first()["cik"] == "0000320193"
    said = spark.createDataFrame([(1, "Exxon Mobil"), (2, "apple"), (3, "xom"), (4, "..."), (5, "Nobody")], "mention_id int, mention string")
    got = {r["mention_id"]: (r["ticker"], r["tier"]) for r in routing.resolved(said, reg, routing.companies(spark)).collect()}
    assert got == {1: ("XOM", 3), 2: ("AAPL", 2), 3: ("XOM", 1), 4: (None, None), 5: (None, None)}
    files = spark.createDataFrame([("a", "a/index.html", 90000), ("a", "a/big.htm", 5000), ("a", "a/small.htm", 3000), ("b", "b/full-submission.txt", 10), ("b", "b/tiny.htm", 10)], "folder string, path string, length long")
    assert {r["path"] for r in filings.primary(files).collect()} == {"a/big.htm", "b/full-submission.txt"}


def test_replies_of_models_are_checked(spark):
    reply = 'Sure: {"query_type": "odd", "tickers": ["aapl", "NFLX"], "other_companies": ["Tesla"], "years": [2024, 1999], "focus": "revenue"}'
    r = routing.validated(spark.createDataFrame([(1, reply), (2, "none")], "query_id int, reply string")).orderBy("query_id").collect()
    assert (r[0]["query_type"], r[0]["tickers"], r[0]["unresolved"], r[0]["years"], r[0]["focus"]) == ("single_doc", ["AAPL"], ["Tesla", "NFLX"], [2024], "revenue")
    assert (r[1]["query_type"], r[1]["tickers"], r[1]["focus"]) == ("single_doc", [], "other")


def test_index_skips_what_it_has(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "chunk_id int, text string, ticker string")
    assert indexing.build(rows.where("ticker = 'x'"), path, ["ticker"]).count() == 1
    assert [r["ticker"] for r in indexing.build(rows, path, ["ticker"]).collect()] == ["y"] or spark.read.parquet(path).count() == 2
    assert spark.read.parquet(path).count() == 2
    assert indexing.dropped(spark, path, {"ticker": "x"}) and spark.read.parquet(path).count() == 1


def test_session_changes(spark):
    t = spark.createDataFrame([("a", 1, None), ("b", 2, 1)], "id string, session_id int, is_correct int")
    rows, missing = sessions.reviewed(t, spark.createDataFrame([("a", 0), ("b", None), ("z", 1)], "id string, is_correct int"))
    assert {(r["id"], r["is_correct"]) for r in rows.collect()} == {("a", 0), ("b", None)} and [r["id"] for r in missing.collect()] == ["z"]
    assert {r["id"] for r in sessions.inserted(t, spark.createDataFrame([("c", 3, None)], t.schema)).collect()} == {"a", "b", "c"}


def test_copies_resume(spark):
    local = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "collection string, id int")
    remote = spark.createDataFrame([("a", 1), ("b", 3), ("d", 9)], "collection string, id int")
    assert {r["collection"]: r["action"] for r in lifecycle.copy_plan(local, remote).collect()} == {"a": "resume", "b": "skip", "c": "copy", "d": "extra"}
    assert {r["id"] for r in lifecycle.to_copy(local, remote).collect()} == {2, 4}


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string").write.parquet(src)
    spark.createDataFrame([(5, "a")], "v int, k string").write.mode("append").parquet(src)
    q = ingest.upserts(spark.readStream.schema("v int, k string").option("maxFilesPerTrigger", 100).parquet(src), out, ["k"], str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(out).where("k = 'a'").count() == 2
    events = spark.readStream.schema("user_id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e") if (tmp_path / "e").mkdir() is None else "")
    assert ingest.first_failures(events, ["user_id"]).isStreaming and ingest.windowed(events).isStreaming and ingest.last_access(events).isStreaming


def test_engine(spark):
    rows = []
    for k, (t, n, _) in enumerate(routing.COMPANIES[:3]):
        for y in (2023, 2024):
            rows += [(f"{t}{y}{i}", f"{n} total revenue grew in {y}. Part {i}.", n, t, y, s, s, "text", i) for i, s in enumerate(["item_1_business", "fs_income_stmt", "item_7_mda"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, company string, ticker string, fiscal_year int, section_id string, section_name string, chunk_type string, position int")
    parents = chunks.select("ticker", "fiscal_year", "section_id", F.col("text").alias("parent_text"))
    engine = Engine(chunks, indexing.hashed(chunks).select("chunk_id", "dense"), parents, routing.companies(spark))
    asked = spark.createDataFrame([(1, "What was Apple revenue in 2024?"), (2, "Compare Apple and Microsoft revenue in 2023 and 2024"), (3, "What is the weather?")], "query_id int, question string")
    out = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert out[1]["route"] == "single" and {(c["ticker"], c["fiscal_year"]) for c in out[1]["citations"]} == {("AAPL", 2024)} and "[1]" in out[1]["answer"]
    assert out[2]["route"] == "synthesis" and {c["ticker"] for c in out[2]["citations"]} == {"AAPL", "MSFT"}
    assert out[3]["route"] == "out_of_scope" and out[3]["citations"] is None


def test_ingest_and_ask(spark, tmp_path):
    from ledgerlark import ingestion
    from ledgerlark.settings import Settings

    folder = tmp_path / "raw" / "AAPL" / "10-K" / "0000320193-24-000123"
    folder.mkdir(parents=True)
    rows = "".join(f"<tr><td>Total net sales part {i}</td><td>{29510 + i}</td></tr>" for i in range(8))
    filler = "".join(f"<p>Filler paragraph number {i} says nothing of note at all.</p>\n" for i in range(60))
    html = f"<html><body>{filler[:900]}<p>Item 1A. Risk Factors</p><p>Many risks may harm our revenue in every market.</p>{filler}<p>Consolidated Statements of Income</p><table><tr><td>Row</td><td>2024</td></tr>{rows}</table>{filler[:600]}</body></html>"
    (folder / "full-submission.txt").write_text(f"CONFORMED PERIOD OF REPORT:\t20240928\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>\n{html}\n</TEXT>\n</DOCUMENT>")
    settings = Settings(raw_dir=str(tmp_path / "raw"), parsed_dir=str(tmp_path / "parsed"), index_dir=str(tmp_path / "index"))
    assert [(r["ticker"], r["fiscal_year"]) for r in ingestion.run(spark, settings).collect()] == [("AAPL", 2024)]
    assert ingestion.run(spark, settings).count() == 0
    chunks = spark.read.parquet(f"{settings.index_dir}/chunks")
    kinds = {(r["section_id"], r["chunk_type"]) for r in chunks.collect()}
    assert ("fs_income_stmt", "table") in kinds and ("item_1a_risk_factors", "text") in kinds
    assert "29510" in chunks.where("chunk_type = 'table'").first()["text"]
    from ledgerlark.__main__ import engine

    asked = spark.createDataFrame([(1, "What was Apple total net sales revenue in 2024?")], "query_id long, question string")
    out = engine(spark, settings).ask(asked).first()
    assert out["route"] == "single" and any(c["section"] == "Consolidated Statements of Income" for c in out["citations"])
    assert Settings.load({"LEDGERLARK_FINAL_K": " 5 ", "LEDGERLARK_RAW_DIR": ""}).final_k == 5


def test_tables_with_tags_that_stay_open():
    cells = "<tr><th>Row<th>Net sales of the whole company<tr><td>2024<td>one hundred and more words in here<tr><td>2023<td>ninety and more words in here"
    text, tables = parsing.parsed_tables(f"<html><head><title>Hidden<body><p>Before</p><table>{cells}</table><p>After")
    assert "Hidden" not in text and "Before" in text and "After" in text and "<<<TABLE_0>>>" in text
    assert tables[0][2] == [["Row", "Net sales of the whole company"], ["2024", "one hundred and more words in here"], ["2023", "ninety and more words in here"]]


def test_words_around_a_nested_table_stay_in_their_cell():
    inner = "<table><tr><td>a</td><td>b</td></tr></table>"
    _, tables = parsing.parsed_tables(f"<table><tr><td>first words {inner} last words of the cell</td><td>one more cell of the outer table</td></tr><tr><td>second row</td><td>with its own words</td></tr></table>")
    assert tables[0][2] == [["first words last words of the cell", "one more cell of the outer table"], ["second row", "with its own words"]]


def test_dense_equals_a_loop_over_collections_and_blocks_of_questions(spark, monkeypatch):
    rng = np.random.default_rng(31)
    own = rng.standard_normal((300, 8))
    own[10] = own[11] = own[12]
    rows = [(i, v.tolist(), f"c{i % 3}" if i % 50 else None) for i, v in enumerate(own)] + [(300, None, "c0"), (301, [0.0] * 8, "c0"), (302, [1.0] * 4, "c0"), (303, [float("nan")] * 8, "c1"), (304, [None, *[1.0] * 7], "c1")]
    vectors = spark.createDataFrame(rows, "chunk_id long, dense array<float>, k string").repartition(4)
    asked = [(f"q{j}", rng.standard_normal(8).tolist()) for j in range(9)] + [("none", None), ("zero", [0.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id string, dense array<double>")
    expected = set()
    x = own.astype(np.float32).astype(float)
    for name, q in asked[:9]:
        score = np.floor(x @ np.array(q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)) * 1e6 + 0.5) / 1e6
        for key in ("c0", "c1", "c2", None):
            for rank, i in enumerate(sorted((i for i in range(300) if rows[i][2] == key), key=lambda i: (-score[i], i))[:4]):
                expected.add((name, key, i, rank))
    for room in (64 << 20, 300):
        monkeypatch.setattr(retrieval, "QUESTION_BYTES", room)
        found = retrieval.dense(vectors, queries, 4, ["k"])
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
        assert {(r["query_id"], r["k"], r["chunk_id"], r["rank"]) for r in found.collect()} == expected
