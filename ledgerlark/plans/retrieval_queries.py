"""Queries of retrieval, from single rankings to whole results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import context, retrieval
from ledgerlark.plans import fixtures as fx
from ledgerlark.plans.registry import query

BM25 = fx.bm25_sql("chunks", "bm")


@query("bm25_topk", f"WITH {fx.CHUNKS_SQL}, {BM25} SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM bm) WHERE rank < 10")
def bm25_topk(spark, sf_dir):
    return retrieval.sparse(fx.chunks(spark, sf_dir), fx.questions(spark, sf_dir), 10)


@query("cosine_topk", f"WITH {fx.CHUNKS_SQL} SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM (SELECT q.query_id, v.chunk_id, round({fx.COSINE_SQL}, 6) AS score FROM vectors v, questions q WHERE q.dense IS NOT NULL)) WHERE rank < 10")
def cosine_topk(spark, sf_dir):
    return retrieval.dense(fx.vectors(spark, sf_dir), fx.questions(spark, sf_dir), 10)


@query("hybrid_rrf", f"WITH {fx.CHUNKS_SQL}, {fx.hybrid_sql('chunks', 'h')} SELECT query_id, source, lang, chunk_id, score, rank FROM h")
def hybrid_rrf(spark, sf_dir):
    return retrieval.hybrid(fx.chunks(spark, sf_dir), fx.vectors(spark, sf_dir), fx.questions(spark, sf_dir), fx.KEYS)


TABLES = "tables AS (SELECT * FROM chunks WHERE chunk_type = 'table')"


@query("hybrid_rrf_filtered", f"WITH {fx.CHUNKS_SQL}, {TABLES}, {fx.hybrid_sql('tables', 'h')} SELECT query_id, source, lang, chunk_id, score, rank FROM h")
def hybrid_rrf_filtered(spark, sf_dir):
    return retrieval.hybrid(fx.chunks(spark, sf_dir), fx.vectors(spark, sf_dir), fx.questions(spark, sf_dir), fx.KEYS, chunk_type="table")


FOCUS_CASE = "CASE focus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in retrieval.FOCUS_SECTION.items()) + " END"
PASSES = f"""{TABLES}, {fx.hybrid_sql("chunks", "h")}, {fx.hybrid_sql("tables", "ht")},
wanted AS (SELECT query_id, 'fs_income_stmt' AS section FROM questions UNION ALL SELECT query_id, {FOCUS_CASE} FROM questions WHERE {FOCUS_CASE} IS NOT NULL),
scrolls AS (
  SELECT query_id, source, lang, chunk_id, 0.4 AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, section, source, lang ORDER BY position, chunk_id) AS n FROM chunks JOIN wanted ON section_id = section) WHERE n <= 5),
found AS (
  SELECT query_id, source, lang, chunk_id, score FROM h UNION ALL SELECT query_id, source, lang, chunk_id, score FROM ht UNION ALL SELECT * FROM scrolls),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM (
    SELECT query_id, chunk_id, max(CAST(score AS DOUBLE)) AS score FROM found GROUP BY ALL)) WHERE rank < 40)"""


@query("multi_pass_dedupe_cap40", f"WITH {fx.CHUNKS_SQL}, {PASSES} SELECT query_id, chunk_id, score, rank FROM best")
def multi_pass_dedupe_cap40(spark, sf_dir):
    return retrieval.candidates(retrieval.passes(fx.chunks(spark, sf_dir), fx.vectors(spark, sf_dir), fx.questions(spark, sf_dir), fx.KEYS))


def _statement(row: str, *phrases: str) -> str:
    there = "contains(s, 'consolidated statements')"
    said = " OR ".join(f"contains(lt, '{p}')" for p in phrases)
    return f"CASE WHEN {there} AND regexp_matches(t, '{row}') THEN 10.0 WHEN {there} THEN 6.0 WHEN regexp_matches(t, '{row}') THEN 2.0 WHEN {said} THEN 0.5 ELSE 0.0 END"


BOOST_SQL = f"""CASE
  WHEN focus = 'revenue' THEN CASE WHEN regexp_matches(t, '{X.REV_ROW}') OR contains(lt, 'total net sales') OR contains(lt, 'total revenue') OR contains(lt, 'total net revenues') THEN 8.0
    WHEN contains(lt, 'net sales') OR contains(lt, 'revenue') THEN 2.0 ELSE 0.0 END
  WHEN focus = 'rd_expense' THEN CASE WHEN regexp_matches(t, '{X.RD_ROW}') THEN 10.0 WHEN contains(lt, 'research and development') THEN 2.0 ELSE 0.0 END
  WHEN focus = 'net_income' THEN {_statement(X.NI_ROW, "net income")}
  WHEN focus = 'operating_income' THEN {_statement(X.OI_ROW, "operating income", "income from operations")}
  WHEN focus = 'balance_sheet' THEN CASE WHEN (contains(s, 'balance sheet') OR contains(s, 'financial condition')) AND regexp_matches(t, '{X.CASH_ROW}') THEN 10.0
    WHEN contains(s, 'balance sheet') OR contains(s, 'financial condition') THEN 6.0 WHEN regexp_matches(t, '{X.CASH_ROW}') OR contains(lt, 'cash and cash equivalents') THEN 2.0 ELSE 0.0 END
  WHEN focus = 'segment_info' THEN CASE WHEN contains(lt, 'segment') AND contains(s, 'notes') THEN 8.0 WHEN contains(lt, 'segment') THEN 4.0 ELSE 0.0 END
  WHEN focus IN ('business_overview', 'risk_factors', 'legal_proceedings', 'cybersecurity') THEN
    CASE WHEN coalesce(regexp_replace(section_id, '__[0-9]+$', '') = ({FOCUS_CASE}), false) AND chunk_type = 'text' THEN 8.0 ELSE 0.0 END
  ELSE 0.0 END"""

# Statement rows per supplier and year, in the forms that boosts look for.
ROWS_SQL = """
statements AS (
  SELECT l_suppkey AS sup, year(l_shipdate) AS yr, CAST(round(sum(l_extendedprice)) AS BIGINT) AS net, CAST(round(sum(l_quantity)) AS BIGINT) AS qty FROM lineitem GROUP BY ALL),
rows AS (
  SELECT sup, yr, sup % 11 AS kind, sup % 8 AS sec,
         '| ' || ['Total net sales', 'Research and development', 'Net income', 'Operating income', 'Cash and cash equivalents', 'Segment assets', 'Revenue', 'Other', 'Income from operations', 'Total cash and cash equivalents', 'Net sales'][sup % 11 + 1]
           || ' | ' || net || ' | ' || qty || ' |' AS t FROM statements)"""


def statement_rows(spark, sf_dir):
    """(sup, yr, kind, sec, text): one row in pipes for each supplier and year.

    Prices are added in the order of the files' rows, as the SQL does: in another order a sum that ends in a half may round to another figure."""
    line = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sup"), F.year("l_shipdate").alias("yr"), "l_extendedprice", "l_quantity", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    order = W.partitionBy("sup", "yr").orderBy("file", "place")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    added = line.withColumns({"net": F.sum("l_extendedprice").over(upto), "qty": F.sum("l_quantity").over(upto), "n": F.row_number().over(order)})
    last = added.groupBy("sup", "yr").agg(F.max_by(F.struct("net", "qty"), "n").alias("last"))
    sums = last.select("sup", "yr", *(F.round(f"last.{c}").cast("long").alias(c) for c in ("net", "qty")))
    names = F.array(*map(F.lit, ("Total net sales", "Research and development", "Net income", "Operating income", "Cash and cash equivalents", "Segment assets", "Revenue", "Other", "Income from operations", "Total cash and cash equivalents", "Net sales")))
    label = F.element_at(names, (F.col("sup") % 11 + 1).cast("int"))
    return sums.select("sup", "yr", (F.col("sup") % 11).alias("kind"), (F.col("sup") % 8).alias("sec"), F.concat(F.lit("| "), label, F.lit(" | "), F.col("net").cast("string"), F.lit(" | "), F.col("qty").cast("string"), F.lit(" |")).alias("text"))


@query("focus_boost", f"""WITH {ROWS_SQL.strip()},
b AS (SELECT sup, yr, f.focus, t, lower(t) AS lt, lower({fx.sql_list([t for _, t in fx.SECTIONS])}[sec + 1]) AS s, {fx.sql_list([s for s, _ in fx.SECTIONS])}[sec + 1] AS section_id,
             CASE WHEN yr % 2 = 0 THEN 'text' ELSE 'table' END AS chunk_type FROM rows, (SELECT unnest({fx.sql_list(fx.FOCI)}) AS focus) f)
SELECT sup, yr, focus, CAST({BOOST_SQL} AS DOUBLE) AS boost FROM b""")
def focus_boost(spark, sf_dir):
    sec = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in fx.SECTIONS)), (F.col("sec") + 1).cast("int"))
    rows = statement_rows(spark, sf_dir).withColumns({"section_id": sec(0), "section_name": sec(1), "chunk_type": F.when(F.col("yr") % 2 == 0, "text").otherwise("table"), "focus": F.explode(F.array(*map(F.lit, fx.FOCI)))})
    return rows.select("sup", "yr", "focus", retrieval.boost().alias("boost"))


@query("diversity_quota", f"""WITH {fx.CHUNKS_SQL}, {BM25},
r AS (SELECT bm.*, source, lang, section_name, chunk_type, k FROM bm JOIN chunks USING (chunk_id) JOIN questions USING (query_id)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, lang, section_name, chunk_type ORDER BY score DESC, chunk_id) AS n FROM r) WHERE n <= 2)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o) WHERE rank <= k""")
def diversity_quota(spark, sf_dir):
    asked, rows = fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)
    groups = [*fx.KEYS, "section_name", "chunk_type"]
    ranked = retrieval.sparse(rows, asked, retrieval.QUOTA, groups).drop("rank").join(asked.select("query_id", "k"), "query_id")
    return retrieval.diverse(ranked, groups, F.col("k")).select("query_id", "chunk_id", "score", "rank")


PARENT_KEYS = [*fx.KEYS, "filing", "section_id"]
PARENTS = "parents AS (SELECT source, lang, filing, section_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS parent_text FROM chunks WHERE section_id <> 'fs_notes' GROUP BY ALL)"
SAME_PARENT = "ON {0}.source = p.source AND {0}.lang = p.lang AND {0}.filing = p.filing AND {0}.section_id = p.section_id"


def parents(rows):
    """Texts of the sections of a filing, of all their chunks; notes have none stored, so that their chunks have no parent."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "text")))
    return rows.where("section_id <> 'fs_notes'").groupBy(*PARENT_KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("parent_text"))


@query("parent_join", f"WITH {fx.CHUNKS_SQL}, {PARENTS} SELECT chunk_id, md5(coalesce(nullif(p.parent_text, ''), c.text)) AS parent_md5 FROM chunks c LEFT JOIN parents p {SAME_PARENT.format('c')}")
def parent_join(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir)
    return retrieval.with_parents(rows, parents(rows), PARENT_KEYS).select("chunk_id", F.md5(F.col("parent_text").cast("binary")).alias("parent_md5"))


def _terms(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'))"


@query("retrieve", f"""WITH {fx.CHUNKS_SQL}, {PASSES}, {PARENTS},
j AS (SELECT b.query_id, c.*, q.question, q.focus, q.k, text AS t, lower(text) AS lt, lower(section_name) AS s FROM best b JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id)),
sc AS (SELECT *, round(coalesce(CAST(len(list_intersect({_terms("question")}, {_terms("text")})) AS DOUBLE) / nullif(len({_terms("question")}), 0), 0) + {BOOST_SQL}, 6) AS score FROM j WHERE chunk_type = 'text' OR chunk_type = 'table'),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, lang, section_name, chunk_type ORDER BY score DESC, chunk_id) AS n FROM sc) WHERE n <= 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o) WHERE rank <= k)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, md5(coalesce(nullif(p.parent_text, ''), r.text)) AS parent_md5
FROM r LEFT JOIN parents p {SAME_PARENT.format("r")}""")
def retrieve(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir)
    found = retrieval.retrieve(rows, fx.vectors(spark, sf_dir), fx.questions(spark, sf_dir), fx.KEYS, parents(rows), parent_keys=PARENT_KEYS)
    return found.select("query_id", "chunk_id", "score", "rank", F.md5(F.col("parent_text").cast("binary")).alias("parent_md5"))


@query("compress_rows")
def compress_rows(spark, sf_dir):
    rows = statement_rows(spark, sf_dir).groupBy("sup").agg(F.array_join(F.concat(F.array(F.lit("| Row | Net | Net |"), F.lit("| --- | --- | --- |")), F.sort_array(F.collect_list(F.concat("text", F.lit(" | |"))))), "\n").alias("text"))
    return rows.select("sup", X.without_noise("text").alias("text"))


@query("context_budget", f"""WITH {fx.CHUNKS_SQL}, {BM25},
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM bm) WHERE rank < 40),
t AS (SELECT query_id, chunk_id, rank, CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS BIGINT) AS tokens FROM r JOIN chunks USING (chunk_id))
SELECT query_id, chunk_id, rank, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM t) WHERE run <= 8500 OR rank = 0""")
def context_budget(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir)
    ranked = retrieval.looked_up(retrieval.sparse(rows, fx.questions(spark, sf_dir), 40), rows.select("chunk_id", "text")).withColumn("tokens", F.regexp_count("text", F.lit(X.TERM)).cast("long"))
    return context.within_budget(ranked).select("query_id", "chunk_id", "rank", "tokens")


@query("target_prune", "SELECT source, lang, count(*) AS points FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang IN ('en', 'de') GROUP BY ALL")
def target_prune(spark, sf_dir):
    return retrieval.collections(retrieval.pruned(fx.chunks(spark, sf_dir), source=["src0", "src1", "src2"], lang=["en", "de"]), fx.KEYS)


@query("list_collections", "SELECT source, lang, count(*) AS points FROM documents GROUP BY ALL")
def list_collections(spark, sf_dir):
    return retrieval.collections(fx.chunks(spark, sf_dir), fx.KEYS)


@query("adaptive_k", """SELECT q, CAST(k AS INTEGER) AS k, CAST(least(2 * k, 15) AS INTEGER) AS retry_k FROM (SELECT o_custkey AS q, 3 * least(greatest(1, count(DISTINCT o_orderstatus)) * greatest(1, count(DISTINCT year(o_orderdate))), 5) AS k FROM orders GROUP BY o_custkey)""")
def adaptive_k(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.collect_set("o_orderstatus").alias("t"), F.collect_set(F.year("o_orderdate")).alias("y"))
    k = retrieval.adaptive_k(F.col("t"), F.col("y"))
    return rows.select("q", k.alias("k"), retrieval.retry_k(k).alias("retry_k"))
