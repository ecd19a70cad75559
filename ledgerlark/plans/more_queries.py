"""Queries of the remaining operators: small steps of parsing, chunking, ranking, state and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import chunking, context, evaluation, lifecycle, parsing, retrieval, routing, sessions
from ledgerlark.plans import fixtures as fx
from ledgerlark.plans.document_queries import FILINGS_SQL, NAMES, RUNS, TERMS, _sha, eval_runs, filing_lines
from ledgerlark.plans.registry import query
from ledgerlark.plans.retrieval_queries import BM25, PASSES, ROWS_SQL, _terms, statement_rows
from ledgerlark.plans.state_queries import SESSIONS_SQL, sessions_of, turns_of
from ledgerlark.sources import filings
from ledgerlark.tables import saved


@query("ixbrl_strip", r"""SELECT page_id, md5(regexp_replace(regexp_replace('<?xml version="1.0"?>' || replace(html, '<p>', '<ix:nonFraction id="x"><p>'), '^\s*<\?xml[^?]*\?>', '', 'i'), '</?(?:ix|xbrli|xbrldi):[^>]*>', '', 'gi')) AS html_md5 FROM pages""")
def ixbrl_strip(spark, sf_dir):
    html = F.concat(F.lit('<?xml version="1.0"?>'), F.replace("html", F.lit("<p>"), F.lit('<ix:nonFraction id="x"><p>')))
    return fx.table(spark, sf_dir, "pages").select("page_id", _sha(parsing.without_tags_of_filings(html)).alias("html_md5"))


@query("embedded_documents", "SELECT doc_id, CAST(part AS INTEGER) AS part, ['first', 'second ' || lang][part + 1] AS html FROM documents, (VALUES (0), (1)) AS v(part) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, lang FROM documents WHERE doc_id % 2 = 1")
def embedded_documents(spark, sf_dir):
    both = F.concat(F.lit("first<!-- ===== embedded document: EX-13 ===== -->second "), F.col("lang"))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, both).otherwise(F.col("lang")).alias("html"))
    return parsing.documents_of(rows)


@query("heading_match", f"WITH {FILINGS_SQL} SELECT doc_id, i, m.section_id AS section_id FROM met WHERE m IS NOT NULL")
def heading_match(spark, sf_dir):
    return parsing.headed(filing_lines(spark, sf_dir)).where("met is not null").select("doc_id", "i", "met.section_id")


@query("heading_select", f"WITH {FILINGS_SQL} SELECT doc_id, section_id, i, title FROM sel")
def heading_select(spark, sf_dir):
    return parsing.selected(parsing.candidates(filing_lines(spark, sf_dir))).select("doc_id", "section_id", "i", "title")


# Filings whose first line heads item 1, before the window of candidates.
EARLY_SQL = FILINGS_SQL.replace("CASE WHEN (doc_id + i) % 5 = 0 THEN", "CASE WHEN i = 1 THEN 'Item 1: Business' WHEN (doc_id + i) % 5 = 0 THEN")


@query("early_business", f"""WITH {EARLY_SQL},
e AS (SELECT doc_id, max(i) AS i FROM met WHERE m.section_id = 'item_1_business' AND i < floor(n_lines * 0.15) AND len(line) <= 250 GROUP BY doc_id)
SELECT doc_id, i FROM e WHERE doc_id NOT IN (SELECT doc_id FROM mono WHERE section_id = 'item_1_business')""")
def early_business(spark, sf_dir):
    lines = filing_lines(spark, sf_dir).withColumn("line", F.when(F.col("i") == 0, "Item 1: Business").otherwise(F.col("line")))
    return parsing.early_business(lines, parsing.monotonic(parsing.selected(parsing.candidates(lines)))).select("doc_id", "i")


@query("statement_recovery", f"""WITH {FILINGS_SQL},
bound AS (SELECT doc_id, i AS start, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n_lines) AS stop FROM mono),
t AS (SELECT doc_id, i, CASE {" ".join("WHEN regexp_matches(lower(line), '" + p + "') THEN '" + s + "'" for p, s, _ in parsing.STATEMENTS)} END AS section_id FROM lines WHERE len(line) BETWEEN 1 AND 120),
f AS (SELECT t.doc_id, t.section_id, min(t.i) AS i FROM t JOIN bound b ON b.doc_id = t.doc_id AND t.i > b.start AND t.i < b.stop WHERE b.stop - b.start >= 3 AND t.section_id IS NOT NULL GROUP BY ALL)
SELECT doc_id, section_id, i FROM f WHERE (doc_id, section_id) NOT IN (SELECT (doc_id, section_id) FROM mono)""")
def statement_recovery(spark, sf_dir):
    lines = filing_lines(spark, sf_dir)
    chosen = saved(parsing.monotonic(parsing.selected(parsing.candidates(lines))))
    return parsing.recovered(lines, chosen, least=3).select("doc_id", "section_id", "i")


# Two documents to a filing, each with headings of its own in the place of every fifth line.
PLANTED = f"CASE WHEN (doc_id + i) % 5 = 0 THEN {fx.sql_list(NAMES)}[(doc_id * 7 + i * 3) % {len(NAMES)} + 1] ELSE ls[i] END"


@query("exhibit_sections", f"""WITH documents AS (SELECT 2 * doc_id + part AS doc_id, text FROM documents, (VALUES (0), (1)) AS v(part)), {FILINGS_SQL.strip()},
bound AS (SELECT doc_id, i AS start, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n_lines) AS stop FROM mono),
t AS (SELECT doc_id, i, CASE {" ".join("WHEN regexp_matches(lower(line), '" + p + "') THEN '" + s + "'" for p, s, _ in parsing.STATEMENTS)} END AS section_id FROM lines WHERE len(line) BETWEEN 1 AND 120),
rec AS (SELECT t.doc_id, t.section_id, min(t.i) AS i FROM t JOIN bound b ON b.doc_id = t.doc_id AND t.i > b.start AND t.i < b.stop WHERE b.stop - b.start >= 1000 AND t.section_id IS NOT NULL GROUP BY ALL),
e AS (SELECT doc_id, max(i) AS i FROM met WHERE m.section_id = 'item_1_business' AND i < floor(n_lines * 0.15) AND len(line) <= 250 GROUP BY doc_id),
every AS (
  SELECT doc_id, section_id, i FROM mono UNION ALL SELECT * FROM rec WHERE (doc_id, section_id) NOT IN (SELECT (doc_id, section_id) FROM mono)
  UNION ALL SELECT doc_id, 'item_1_business', i FROM e WHERE doc_id NOT IN (SELECT doc_id FROM mono WHERE section_id = 'item_1_business')),
own AS (SELECT doc_id, list({PLANTED} ORDER BY i) AS ls FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) GROUP BY doc_id),
pair AS (SELECT a.doc_id // 2 AS doc, list_concat(a.ls, b.ls) AS ls, len(a.ls) AS first FROM own a JOIN own b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
placed AS (SELECT doc, section_id, i + CASE WHEN doc_id % 2 = 1 THEN first ELSE 0 END AS i, ls FROM every JOIN pair ON doc = doc_id // 2),
num AS (SELECT *, row_number() OVER (PARTITION BY doc, section_id ORDER BY i) AS n, lead(i) OVER (PARTITION BY doc ORDER BY i) AS stop, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS section_order FROM placed),
b AS (
  SELECT doc AS doc_id, section_id || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS section_id, section_order, array_to_string(list_slice(ls, i + 2, coalesce(stop, len(ls))), chr(10)) AS body FROM num
  UNION ALL SELECT doc, 'full_document', 0, array_to_string(ls, chr(10)) FROM pair WHERE doc NOT IN (SELECT doc FROM placed))
SELECT doc_id, section_id, CAST(section_order AS INTEGER) AS section_order, md5(body) AS body_md5 FROM b WHERE regexp_matches(body, '\\S')""")
def exhibit_sections(spark, sf_dir):
    piece = F.col("doc_id") * 2 + F.col("part")
    name = lambda i: F.element_at(F.array(*map(F.lit, NAMES)), ((piece * 7 + i * 3) % len(NAMES) + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.when((piece + k + 1) % 5 == 0, name(k + 1)).otherwise(x))
    parts = fx.table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).select("doc_id", "part", F.array_join(lines, "\n").alias("text"))
    return parsing.sections_of_parts(parts).select("doc_id", "section_id", "section_order", _sha(F.col("body")).alias("body_md5"))


@query("chunk_types", f"WITH {fx.CHUNKS_SQL} SELECT source, count(*) FILTER (WHERE chunk_type = 'table') AS tables, count(*) FILTER (WHERE chunk_type = 'text') AS texts FROM chunks GROUP BY source")
def chunk_types(spark, sf_dir):
    return fx.chunks(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("chunk_type") == "table").alias("tables"), F.count_if(F.col("chunk_type") == "text").alias("texts"))


@query("chunk_identity", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS position, sha256(source || '|' || lang || '|' || (row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1)) AS chunk_id FROM documents")
def chunk_identity(spark, sf_dir):
    return chunking.identified(fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["lang", "doc_id"], "source", "lang").select("doc_id", "source", F.col("position").cast("long").alias("position"), "chunk_id")


@query("table_enrichment", f"""WITH {ROWS_SQL.strip()}
SELECT sup, yr, 0 AS position, 'Supplier ' || sup || ' (S' || sup || ') FY' || yr || ' — Rows' || chr(10) || t AS chunk_text, CAST(len(regexp_extract_all(t, '\\w+|[^\\w\\s]')) AS INTEGER) AS token_count FROM rows""")
def table_enrichment(spark, sf_dir):
    k = F.col("sup").cast("string")
    rows = statement_rows(spark, sf_dir).select("sup", "yr", "text", F.concat(F.lit("Supplier "), k).alias("company"), F.concat(F.lit("S"), k).alias("ticker"), F.col("yr").alias("fiscal_year"), F.lit("Rows").alias("section_name"))
    return chunking.enriched(rows).select("sup", "yr", "position", "chunk_text", "token_count")


@query("section_scroll", f"""WITH {fx.CHUNKS_SQL}
SELECT query_id, source, lang, chunk_id, 0.4::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, lang ORDER BY position, chunk_id) AS n FROM chunks, questions WHERE section_id = 'fs_income_stmt') WHERE n <= 5""")
def section_scroll(spark, sf_dir):
    return retrieval.scroll(fx.chunks(spark, sf_dir), fx.questions(spark, sf_dir), F.lit(retrieval.INCOME), fx.KEYS)


@query("rerank", f"""WITH {fx.CHUNKS_SQL}, {BM25},
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM bm) WHERE n <= 40),
s AS (SELECT query_id, chunk_id, round(CAST(len(list_intersect({_terms("question")}, {_terms("text")})) AS DOUBLE) / len({_terms("question")}), 6) AS score FROM r JOIN chunks USING (chunk_id) JOIN questions USING (query_id))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s) WHERE rank < 15""")
def rerank(spark, sf_dir):
    rows, asked = fx.chunks(spark, sf_dir), fx.questions(spark, sf_dir)
    found = retrieval.sparse(rows, asked, retrieval.CANDIDATES).select("query_id", "chunk_id")
    pairs = retrieval.looked_up(found, rows.select("chunk_id", "text")).join(asked.select("query_id", "question"), "query_id")
    return retrieval.top(pairs.select("query_id", "chunk_id", F.round(retrieval.overlap_score("question", "text"), 6).alias("score")), 15, ["query_id"])


@query("first_seen_groups", f"""WITH {fx.CHUNKS_SQL}, {PASSES},
g AS (SELECT query_id, source, lang, section_name, min(rank) AS first, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS text_md5, max(score) AS score FROM best JOIN chunks USING (chunk_id) GROUP BY ALL)
SELECT query_id, source, lang, section_name, first, text_md5, score FROM g""")
def first_seen_groups(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir)
    best = retrieval.looked_up(retrieval.candidates(retrieval.passes(rows, fx.vectors(spark, sf_dir), fx.questions(spark, sf_dir), fx.KEYS)), rows)
    keys = [*fx.KEYS, "section_name"]
    return context.grouped(best, keys).select("query_id", *keys, "first", _sha(F.col("text")).alias("text_md5"), "score")


@query("contexts_and_citations")
def contexts_and_citations(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir)
    asked = fx.questions(spark, sf_dir)
    found = retrieval.retrieve(rows, fx.vectors(spark, sf_dir), asked, fx.KEYS).withColumn("parent_text", F.col("text"))
    sources = saved(context.contexts(found, [*fx.KEYS, "section_name", "chunk_type"]))
    told = context.extracted(sources).select("query_id", _sha(F.col("answer")).alias("answer_md5"))
    named = sources.withColumns({"company": F.col("source"), "ticker": F.col("source"), "fiscal_year": F.lit(2024)})
    return told.join(context.citations(named).select("query_id", F.size("citations").alias("n"), F.to_json("citations").alias("citations")), "query_id")


@query("turn_reviews", f"""WITH {SESSIONS_SQL.strip()}
SELECT id, CASE WHEN created_at % 5 = 0 THEN NULL WHEN created_at % 5 = 1 THEN 1 ELSE is_correct END AS is_correct FROM turns""")
def turn_reviews(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    marks = turns.where("created_at % 5 < 2").select("id", F.when(F.col("created_at") % 5 == 1, 1).cast("int").alias("is_correct"))
    return sessions.reviewed(turns, marks)[0].select("id", "is_correct")


@query("session_touch", f"WITH {SESSIONS_SQL.strip()} SELECT s.id, greatest(s.updated_at, max(t.created_at) + 100) AS updated_at FROM sessions s LEFT JOIN turns t ON t.session_id = s.id GROUP BY s.id, s.updated_at")
def session_touch(spark, sf_dir):
    return sessions.touched(sessions_of(spark, sf_dir), turns_of(spark, sf_dir).withColumn("created_at", F.col("created_at") + 100)).select("id", "updated_at")


@query("turn_insert", f"WITH {SESSIONS_SQL.strip()} SELECT session_id, count(*) AS n, sum(created_at) AS at FROM (SELECT session_id, CASE WHEN created_at % 4 = 0 THEN created_at + 1000 ELSE created_at END AS created_at FROM turns) GROUP BY session_id")
def turn_insert(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    rows = sessions.inserted(turns, turns.where("created_at % 4 = 0").withColumn("created_at", F.col("created_at") + 1000))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("created_at").alias("at"))


@query("copy_resume", "SELECT doc_id FROM documents WHERE lang <> 'es' AND NOT (doc_id % 3 = 0 AND lang = 'en')")
def copy_resume(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("id"), "lang")
    return lifecycle.to_copy(d.where("lang <> 'es'"), d.where("id % 3 = 0 and lang = 'en'")).select(F.col("id").alias("doc_id"))


@query("manifest_dimension", f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{n}', '{s}')" for t, n, s in routing.COMPANIES)}) AS v(ticker, name, sector)),
f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE {fx.sql_list([t for t, _, _ in routing.COMPANIES])}[doc_id % 12 + 1] END AS ticker FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS file_path, ticker, coalesce(name, ticker) AS company, coalesce(sector, 'Unknown') AS sector FROM f LEFT JOIN c USING (ticker)""")
def manifest_dimension(spark, sf_dir):
    k = F.col("doc_id")
    ticker = F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).otherwise(F.element_at(F.array(*(F.lit(t) for t, _, _ in routing.COMPANIES)), (k % 12 + 1).cast("int")))
    rows = fx.table(spark, sf_dir, "documents").select(ticker.alias("ticker"), F.lit("10-K").alias("filing_type"), F.lit(2024).alias("fiscal_year"), F.lit("").alias("accession_number"), k.cast("string").alias("file_path"))
    return filings.manifest(rows, routing.companies(spark)).select("file_path", "ticker", "company", "sector")


@query("indexed_years", "SELECT o_custkey AS k, max(year(o_orderdate)) AS latest, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') AS years FROM orders GROUP BY o_custkey")
def indexed_years(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"))
    return rows.groupBy("k").agg(F.max("y").alias("latest"), F.array_join(F.sort_array(F.collect_set("y")).cast("array<string>"), ",").alias("years"))


@query("routes", """WITH q AS (SELECT o_custkey AS query_id, o_custkey % 3 AS n, o_custkey % 5 AS u, ['single_doc', 'multi_doc', 'temporal', 'out_of_scope'][o_custkey % 4 + 1] AS query_type, ['revenue', 'other'][o_custkey % 2 + 1] AS focus, min(year(o_orderdate)) AS y FROM orders GROUP BY o_custkey),
h AS (SELECT 'A' AS ticker, 1992 AS y UNION ALL SELECT 'A', 1993 UNION ALL SELECT 'B', 1992)
SELECT query_id, CASE WHEN query_type = 'out_of_scope' AND n = 0 THEN 'out_of_scope' WHEN n = 0 AND u > 0 THEN 'unresolved_company' WHEN n = 0 THEN 'clarification_needed' WHEN query_type IN ('multi_doc', 'temporal') THEN 'synthesis' ELSE 'single' END AS route,
       array_to_string(list_filter(['A', 'B'][1 : n], lambda t: query_type <> 'temporal' AND focus = 'revenue' AND NOT list_contains(CASE WHEN t = 'A' THEN [1992, 1993] ELSE [1992] END, y)), ',') AS missing FROM q""")
def routes(spark, sf_dir):
    k = F.col("o_custkey")
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y"))
    rows = rows.select(k.alias("query_id"), pick(["single_doc", "multi_doc", "temporal", "out_of_scope"], 4).alias("query_type"), pick(["revenue", "other"], 2).alias("focus"), F.array("y").alias("years"), F.slice(F.array(F.lit("A"), F.lit("B")), F.lit(1), (k % 3).cast("int")).alias("tickers"), F.slice(F.array(*[F.lit("?")] * 4), F.lit(1), (k % 5).cast("int")).alias("unresolved"))
    have = spark.createDataFrame([("A", 1992), ("A", 1993), ("B", 1992)], "ticker string, fiscal_year int")
    return routing.outcomes(rows, have).select("query_id", "route", F.array_join("missing_years", ",").alias("missing"))


@query("reply_validation", """SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 3 THEN 'temporal' ELSE 'single_doc' END AS query_type, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'AAPL' END AS tickers, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'Tesla,NFLX' END AS unresolved, CASE WHEN event_id % 4 = 3 THEN '' ELSE '2024' END AS years FROM events""")
def reply_validation(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "temporal").otherwise("odd")
    good = F.concat(F.lit('Well: {"query_type": "'), kind, F.lit('", "tickers": ["aapl", "NFLX"], "other_companies": ["Tesla"], "years": [2024, 1999]}'))
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 3, "no object").otherwise(good).alias("reply"))
    out = routing.validated(rows)
    return out.select("event_id", "query_type", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("tickers", "unresolved", "years")))


@query("truncate_tokens", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\s*(?:\w+|[^\w\s])') AS p FROM documents)
SELECT doc_id, md5(CASE WHEN len(p) > 100 THEN array_to_string(p[1:100], '') || ' …' ELSE text END) AS cut_md5 FROM t""")
def truncate_tokens(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", _sha(X.truncated("text", 100)).alias("cut_md5"))


@query("eval_summary", f"""WITH {RUNS},
m AS (SELECT round(CAST(len(list_intersect({TERMS("question")}, {TERMS("joined")})) AS DOUBLE) / len({TERMS("question")}), 6) AS f, round(CAST(cp AS DOUBLE), 6) AS p FROM g)
SELECT round(avg(f), 6) AS faithfulness, 1.0::DOUBLE AS answer_relevancy, round(avg(p), 6) AS context_precision, round(avg(f), 6) AS context_recall,
       round((round(avg(f), 6) + 1.0 + round(avg(p), 6) + round(avg(f), 6)) / 4, 6) AS overall FROM m""")
def eval_summary(spark, sf_dir):
    return evaluation.summary(evaluation.scored(eval_runs(spark, sf_dir)))
