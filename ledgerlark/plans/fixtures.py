"""How the tables at hand stand in for filings: documents are chunks, (source, lang) their collection, and so on.
Each function has the same rows as the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang"]
FOCI = ["revenue", "rd_expense", "net_income", "operating_income", "balance_sheet", "segment_info", "business_overview", "risk_factors", "legal_proceedings", "cybersecurity", "other"]
SECTIONS = [
    ("item_1_business", "Item 1: Business"), ("item_1a_risk_factors", "Item 1A: Risk Factors"), ("item_1c_cyber", "Item 1C: Cybersecurity"), ("item_3_legal", "Item 3: Legal Proceedings"),
    ("fs_income_stmt", "Consolidated Statements of Income"), ("fs_balance_sheet", "Consolidated Balance Sheets"), ("fs_notes", "Notes to Financial Statements"), ("item_7_mda", "Item 7: MD&A"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], by) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % len(SECTIONS)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), *KEYS, "text", F.col("doc_id").alias("position"), _pick([s for s, _ in SECTIONS], n).alias("section_id"), _pick([t for _, t in SECTIONS], n).alias("section_name"),
        F.when(F.contains("text", F.lit("|")), "table").otherwise("text").alias("chunk_type"), F.floor(F.col("doc_id") / 1000).alias("filing"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), _pick(FOCI, F.col("item_id") % len(FOCI)).alias("focus"), (F.lit(3) * (F.col("item_id") % 5 + 1)).cast("int").alias("k"))
    return asked.join(vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id"), "query_id", "left")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CHUNKS_SQL = f"""
chunks AS (
  SELECT doc_id AS chunk_id, source, lang, text, doc_id AS position, {sql_list([s for s, _ in SECTIONS])}[doc_id % {len(SECTIONS)} + 1] AS section_id,
         {sql_list([t for _, t in SECTIONS])}[doc_id % {len(SECTIONS)} + 1] AS section_name, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS chunk_type, doc_id // 1000 AS filing FROM documents),
vectors AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS dense FROM embeddings),
questions AS (
  SELECT item_id AS query_id, text AS question, {sql_list(FOCI)}[item_id % {len(FOCI)} + 1] AS focus, CAST(3 * (item_id % 5 + 1) AS INTEGER) AS k, v.dense
  FROM benchmark b LEFT JOIN vectors v ON v.chunk_id = b.item_id)"""
COSINE_SQL = "list_dot_product(v.dense, q.dense) / (sqrt(list_dot_product(v.dense, v.dense)) * sqrt(list_dot_product(q.dense, q.dense)))"


def bm25_sql(scope: str, name: str) -> str:
    """CTEs that end in `name` (query_id, chunk_id, score), over the chunks of the relation `scope`."""
    t = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
    return f"""
{name}_tok AS (SELECT chunk_id, {t.format("text")} AS toks FROM {scope}),
{name}_stat AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM {name}_tok),
{name}_q AS (SELECT DISTINCT query_id, unnest({t.format("question")}) AS term FROM questions),
{name}_tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM {name}_q JOIN {name}_df USING (term) JOIN {name}_tf USING (term), {name}_stat GROUP BY ALL)"""


def hybrid_sql(scope: str, name: str, k: int = 10) -> str:
    """CTEs that end in `name` (query_id, source, lang, chunk_id, score, rank)."""
    return f"""{bm25_sql(scope, name + "_s")},
{name}_d AS (SELECT q.query_id, v.chunk_id, round({COSINE_SQL}, 6) AS score FROM vectors v, questions q WHERE q.dense IS NOT NULL),
{name}_l AS (
  SELECT *, row_number() OVER (PARTITION BY leg, query_id, source, lang ORDER BY score DESC, chunk_id) - 1 AS rank FROM (
    SELECT 1 AS leg, d.*, source, lang FROM {name}_d d JOIN {scope} c ON c.chunk_id = d.chunk_id WHERE score IS NOT NULL
    UNION ALL SELECT 2, s.*, source, lang FROM {name}_s s JOIN {scope} c ON c.chunk_id = s.chunk_id)),
{name}_f AS (SELECT query_id, source, lang, chunk_id, round(sum(1.0 / (2 + rank)), 6) AS score FROM {name}_l WHERE rank < {k} GROUP BY ALL),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, lang ORDER BY score DESC, chunk_id) - 1 AS rank FROM {name}_f) WHERE rank < {k})"""
