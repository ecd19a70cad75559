"""Queries of answers: companies and years that can be searched, refusals asked once more, sub-answers put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import answering, retrieval, routing
from ledgerlark.plans import fixtures as fx
from ledgerlark.plans import retrieval_queries  # noqa: F401  its SQL is part of refusal_retry's
from ledgerlark.plans.registry import ORACLES, query
from ledgerlark.plans.state_queries import NORM

YEAR_OF = {"en": 2023, "de": 2024, "fr": 2025, "es": 2024}
KINDS, TOPICS = ["single_doc", "multi_doc", "temporal", "out_of_scope"], ["revenue", "other", "net_income"]

# A question for each document: about its source, an unknown one or none, with names that are sources, parts of one, or nobody's.
_YEAR_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in YEAR_OF.items()) + " END"
_SAME = f"contains({NORM('mention')}, {NORM('ticker')}) OR contains({NORM('ticker')}, {NORM('mention')})"


@query("company_outcomes", f"""WITH d AS (SELECT *, upper(source) AS own FROM documents),
have AS (SELECT upper(source) AS ticker, list_sort(list_distinct(list({_YEAR_SQL}))) AS have FROM documents GROUP BY 1),
q AS (
  SELECT doc_id AS query_id, {fx.sql_list(KINDS)}[doc_id % 4 + 1] AS kind, {fx.sql_list(TOPICS)}[doc_id % 3 + 1] AS focus, CASE doc_id % 5 WHEN 0 THEN [] WHEN 4 THEN [own, 'NONE'] ELSE [own] END AS ts,
         CASE doc_id % 6 WHEN 0 THEN [] WHEN 1 THEN [2023] WHEN 2 THEN [2024, 2023] ELSE [2025] END AS years,
         CASE doc_id % 7 WHEN 0 THEN ['src' || doc_id % 40] WHEN 1 THEN ['Nobody ' || doc_id % 9] WHEN 2 THEN ['Nobody ' || doc_id % 9, 'The SRC' || doc_id % 30 || ' Co'] ELSE [] END AS names FROM d),
g AS (SELECT *, CASE WHEN kind <> 'temporal' AND focus IN ('revenue', 'net_income') THEN years[1] END AS target FROM q),
m AS (SELECT DISTINCT unnest(names) AS mention FROM q),
r AS (
  SELECT mention, ticker FROM (SELECT mention, ticker, row_number() OVER (PARTITION BY mention ORDER BY CASE WHEN ticker = upper(trim(mention)) THEN 1 ELSE 2 END, length(ticker), ticker) AS n
  FROM m JOIN have ON ticker = upper(trim(mention)) OR {_SAME} OR contains(replace({NORM('mention')}, ' ', ''), {NORM('ticker')}) OR contains({NORM('ticker')}, replace({NORM('mention')}, ' ', ''))) WHERE n = 1),
said AS (SELECT query_id, i, names[i] AS mention, r.ticker FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM g) x LEFT JOIN r ON r.mention = x.names[i]),
lost AS (SELECT query_id, string_agg(mention, ',' ORDER BY i) AS failed FROM said WHERE ticker IS NULL GROUP BY 1),
w AS (
  SELECT query_id, ticker, min(i) AS i FROM (SELECT query_id, ts[i] AS ticker, i FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM g) UNION ALL SELECT query_id, ticker, 1000 + i FROM said WHERE ticker IS NOT NULL) GROUP BY ALL),
s AS (
  SELECT w.*, g.target, g.years, have, CASE WHEN have IS NULL THEN NULL WHEN g.target IS NULL THEN have[len(have)] WHEN list_contains(have, g.target) THEN g.target END AS sure
  FROM w JOIN g USING (query_id) LEFT JOIN have USING (ticker)),
c AS (
  SELECT query_id, string_agg(ticker, ',' ORDER BY i) FILTER (WHERE sure IS NOT NULL) AS tickers, count(sure) AS n,
         string_agg(ticker || ' ' || array_to_string(list_sort(list_distinct(list_append(list_filter(years, lambda y: list_contains(have, y)), sure))), '+'), ',' ORDER BY i) FILTER (WHERE sure IS NOT NULL) AS targets,
         string_agg(ticker, ',' ORDER BY i) FILTER (WHERE have IS NULL) AS ingest_failed,
         string_agg(ticker || ' (asked for FY' || target || ', have FY' || array_to_string(have, '/FY') || ')', ',' ORDER BY i) FILTER (WHERE have IS NOT NULL AND sure IS NULL) AS no_year
  FROM s GROUP BY query_id),
o AS (
  SELECT g.query_id, CASE WHEN kind = 'out_of_scope' AND coalesce(n, 0) > 1 THEN 'multi_doc' WHEN kind = 'out_of_scope' AND coalesce(n, 0) > 0 THEN 'single_doc' ELSE kind END AS query_type, coalesce(n, 0) AS n,
         coalesce(tickers, '') AS tickers, coalesce(targets, '') AS targets, coalesce(ingest_failed, '') AS ingest_failed, coalesce(no_year, '') AS year_not_available, coalesce(failed, '') AS failed_lookups
  FROM g LEFT JOIN c USING (query_id) LEFT JOIN lost USING (query_id))
SELECT query_id, query_type, tickers, targets, ingest_failed, year_not_available, failed_lookups,
       CASE WHEN query_type = 'out_of_scope' THEN 'out_of_scope' WHEN n = 0 AND ingest_failed || year_not_available || failed_lookups <> '' THEN 'unresolved_company' WHEN n = 0 THEN 'clarification_needed'
            WHEN query_type IN ('multi_doc', 'temporal') THEN 'synthesis' ELSE 'single' END AS route FROM o""")
def company_outcomes(spark, sf_dir):
    d, k = fx.table(spark, sf_dir, "documents"), F.col("doc_id")
    year = F.element_at(F.create_map(*(F.lit(x) for kv in YEAR_OF.items() for x in kv)), F.col("lang"))
    have = d.select(F.upper("source").alias("ticker"), year.alias("fiscal_year")).distinct()
    registry = have.select("ticker", F.col("ticker").alias("title"), F.regexp_extract("ticker", r"(\d*)$", 1).try_cast("int").alias("ord")).distinct()
    own, none = F.upper("source"), F.array().cast("array<string>")
    nobody = F.concat(F.lit("Nobody "), (k % 9).cast("string"))
    asked = d.select(
        k.alias("query_id"), fx._pick(KINDS, k % 4).alias("query_type"), fx._pick(TOPICS, k % 3).alias("focus"), F.when(k % 5 == 0, none).when(k % 5 == 4, F.array(own, F.lit("NONE"))).otherwise(F.array(own)).alias("tickers"),
        F.when(k % 6 == 0, F.array().cast("array<int>")).when(k % 6 == 1, F.array(F.lit(2023))).when(k % 6 == 2, F.array(F.lit(2024), F.lit(2023))).otherwise(F.array(F.lit(2025))).alias("years"),
        F.when(k % 7 == 0, F.array(F.concat(F.lit("src"), (k % 40).cast("string")))).when(k % 7 == 1, F.array(nobody)).when(k % 7 == 2, F.array(nobody, F.concat(F.lit("The SRC"), (k % 30).cast("string"), F.lit(" Co")))).otherwise(none).alias("unresolved"),
    )
    out = routing.ensured(asked, registry, routing.companies(spark), have)
    joined = lambda t: F.concat(t, F.lit(" "), F.array_join(F.transform(F.filter("targets", lambda x: x["ticker"] == t), lambda x: x["year"].cast("string")), "+"))
    lists = [F.array_join(c, ",").alias(c) for c in ("tickers", "ingest_failed", "year_not_available", "failed_lookups")]
    return out.select("query_id", "query_type", *lists, F.array_join(F.transform("tickers", joined), ",").alias("targets"), "route")


# A generator that refuses: every third question for good, every other third with fewer than ten sources.
REFUSED = "The answer cannot be found in the excerpts."


def _respond(spark, sf_dir):
    rows, vectors = fx.chunks(spark, sf_dir), fx.vectors(spark, sf_dir)

    def respond(asked):
        found = retrieval.retrieve(rows, vectors, asked, fx.KEYS).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(F.array_join(F.sort_array(F.collect_list("chunk_id")).cast("array<string>"), ",").cast("binary")).alias("chunks_md5"))
        no = (F.col("query_id") % 3 == 2) | ((F.col("query_id") % 3 == 1) & (F.col("n_chunks") < 10))
        return found.withColumn("answer", F.when(no, REFUSED).otherwise(F.concat(F.col("n_chunks").cast("string"), F.lit(" excerpts say so."))))

    return respond


@query("refusal_retry")
def refusal_retry(spark, sf_dir):
    told = answering.with_retry(fx.questions(spark, sf_dir), _respond(spark, sf_dir))
    return told.select("query_id", "answer", "n_chunks", "chunks_md5", "retried", "mended")


def _answers_sql() -> str:
    """The rows of one pass, from the SQL of `retrieve`; a second pass has other questions."""
    body = ORACLES["retrieve"]
    return f"""SELECT query_id, count(*) AS n_chunks, md5(string_agg(chunk_id, ',' ORDER BY chunk_id)) AS chunks_md5 FROM ({body}) GROUP BY query_id"""


def _retry_sql() -> str:
    focus = f"{fx.sql_list(fx.FOCI)}[item_id % {len(fx.FOCI)} + 1] AS focus, CAST(3 * (item_id % 5 + 1) AS INTEGER) AS k"
    first, again = _answers_sql(), _answers_sql().replace(focus, "'other' AS focus, CAST(least(6 * (item_id % 5 + 1), 15) AS INTEGER) AS k")
    answer = f"CASE WHEN query_id % 3 = 2 OR (query_id % 3 = 1 AND n_chunks < 10) THEN '{REFUSED}' ELSE n_chunks || ' excerpts say so.' END AS answer"
    return f"""WITH a AS (SELECT *, {answer} FROM ({first})), b AS (SELECT *, {answer} FROM ({again})),
j AS (SELECT item_id AS query_id, a.* EXCLUDE (query_id), a.answer IS NULL OR a.answer = '{REFUSED}' AS retried, b.answer AS b_answer, b.n_chunks AS b_n, b.chunks_md5 AS b_md5 FROM benchmark LEFT JOIN a ON a.query_id = item_id LEFT JOIN b ON b.query_id = item_id),
k AS (SELECT *, retried AND coalesce(b_answer <> '{REFUSED}', false) AS mended FROM j)
SELECT query_id, CASE WHEN mended THEN b_answer ELSE answer END AS answer, CASE WHEN mended THEN b_n ELSE n_chunks END AS n_chunks, CASE WHEN mended THEN b_md5 ELSE chunks_md5 END AS chunks_md5, retried, mended FROM k"""


ORACLES["refusal_retry"] = _retry_sql()


@query("sub_answers", f"""WITH d AS (SELECT doc_id, source AS ticker, {_YEAR_SQL} AS year, doc_id // 10 AS query_id, doc_id % 10 AS ord, doc_id % 4 AS n, text FROM documents),
s AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY ord) - n AS off, left(regexp_replace(coalesce(text, ''), '[\\[\\]]', '', 'g'), 20) || array_to_string(list_transform(range(1, n + 1), lambda i: '[' || (i + sum_off) || ']'), '') AS body
      FROM (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY ord) - n AS sum_off FROM d) WHERE n > 0)
SELECT q.query_id, coalesce(md5(string_agg('### ' || ticker || ' FY' || year || chr(10) || 'Q' || ord || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY ord)), md5('{answering.NOTHING_FOUND}')) AS answer_md5, coalesce(CAST(sum(n) AS INTEGER), 0) AS n_citations, coalesce(CAST(sum(n) AS INTEGER), 0) AS last
FROM (SELECT DISTINCT query_id FROM d) q LEFT JOIN s USING (query_id) GROUP BY q.query_id""")
def sub_answers(spark, sf_dir):
    k = F.col("doc_id")
    year = F.element_at(F.create_map(*(F.lit(x) for kv in YEAR_OF.items() for x in kv)), F.col("lang"))
    numbers = F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    text = F.concat(F.left(F.regexp_replace(X.text_of("text"), r"[\[\]]", ""), F.lit(20)), F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ""))
    rows = fx.table(spark, sf_dir, "documents").select(F.floor(k / 10).alias("query_id"), (k % 10).alias("ord"), F.col("source").alias("ticker"), year.alias("year"), F.concat(F.lit("Q"), (k % 10).cast("string")).alias("question"), text.alias("answer"), F.transform(numbers, lambda i: F.struct(i.alias("index"))).alias("citations"))
    asked = rows.select("query_id", F.lit("?").alias("question")).distinct()
    out = answering.synthesised(asked, rows)
    last = F.coalesce(F.array_max(F.transform("citations", lambda c: c["index"])), F.lit(0))
    return out.select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.greatest(F.size("citations"), F.lit(0)).alias("n_citations"), last.alias("last"))
