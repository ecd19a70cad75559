"""Queries over documents and pages: scalars, parsing and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import chunking, evaluation, indexing, matching, parsing, retrieval
from ledgerlark.plans import fixtures as fx
from ledgerlark.plans.registry import query
from ledgerlark.plans.retrieval_queries import ROWS_SQL, statement_rows

TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'))"


def _sha(c):
    return F.md5(F.coalesce(c, F.lit("")).cast("binary"))


@query("token_count", r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]')) AS INTEGER) AS n FROM documents")
def token_count(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.token_count("text").alias("n"))


@query("sentence_split", r"SELECT doc_id, CAST(len(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS INTEGER) AS n FROM documents")
def sentence_split(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences("text")).alias("n"))


@query("normalize_text", "SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS norm_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", _sha(X.normal_name("text")).alias("norm_md5"))


@query("sentence_pack")
def sentence_pack(spark, sf_dir):
    rows = chunking.text_chunks(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), most=200)
    return rows.select("doc_id", "position", "token_count", _sha(F.col("chunk_text")).alias("chunk_md5"))


STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<noscript\b[^>]*>.*?</noscript\s*>', '', 'g'), '(?is)<(?:meta|link)\b[^>]*>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"""
PLAIN = f"regexp_replace(replace(replace(replace(replace(replace({STRIP}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"


@query("html_strip", f"SELECT page_id, md5({PLAIN}) AS text_md5 FROM pages")
def html_strip(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", _sha(parsing.visible_text("html")).alias("text_md5"))


# Filings made of documents: every fifth line takes a heading in the place of its text.
NAMES = [t for _, _, t in parsing.HEADINGS]
FILINGS_SQL = f"""
lines AS (
  SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(i - 1 AS INTEGER) AS i,
         CASE WHEN (doc_id + i) % 5 = 0 THEN {fx.sql_list(NAMES)}[(doc_id * 7 + i * 3) % {len(NAMES)} + 1] ELSE trim(ls[i]) END AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
met AS (
  SELECT doc_id, n_lines, i, line, CASE {" ".join("WHEN regexp_matches(lower(line), '" + p + "') THEN {'section_id': '" + s + "', 'title': '" + t.replace("'", "''") + "'}" for p, s, t in parsing.HEADINGS)} END AS m FROM lines),
cand AS (
  SELECT doc_id, n_lines, i, m.section_id, m.title, len(line) AS width FROM met
  WHERE m IS NOT NULL AND i BETWEEN floor(n_lines * 0.15) AND floor(n_lines * 0.97) AND len(line) BETWEEN 1 AND 250),
sel AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY CASE WHEN starts_with(section_id, 'fs_') AND width > 100 THEN 1 ELSE 0 END, CASE WHEN starts_with(section_id, 'fs_') THEN -i ELSE i END) AS n FROM cand) WHERE n = 1),
pri AS (SELECT *, CASE section_id {" ".join(f"WHEN '{k}' THEN {v}" for k, v in parsing.PRIORITY.items())} ELSE 500 END AS p FROM sel WHERE starts_with(section_id, 'item_')),
mono AS (
  SELECT doc_id, section_id, n_lines, i, title FROM (SELECT *, max(p) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM pri) WHERE p > coalesce(so_far, -1)
  UNION ALL SELECT doc_id, section_id, n_lines, i, title FROM sel WHERE starts_with(section_id, 'fs_'))"""


def filing_lines(spark, sf_dir):
    rows = parsing.lines_of(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.col("i") + 1
    named = F.element_at(F.array(*map(F.lit, NAMES)), ((F.col("doc_id") * 7 + at * 3) % len(NAMES) + 1).cast("int"))
    return rows.withColumn("line", F.when((F.col("doc_id") + at) % 5 == 0, named).otherwise(F.col("line")))


@query("section_candidates", f"WITH {FILINGS_SQL} SELECT doc_id, i, section_id, title FROM cand")
def section_candidates(spark, sf_dir):
    return parsing.candidates(filing_lines(spark, sf_dir)).select("doc_id", "i", "section_id", "title")


@query("monotonic_filter", f"WITH {FILINGS_SQL} SELECT doc_id, i, section_id, title FROM mono")
def monotonic_filter(spark, sf_dir):
    return parsing.monotonic(parsing.selected(parsing.candidates(filing_lines(spark, sf_dir)))).select("doc_id", "i", "section_id", "title")


@query("section_numbers", f"""WITH {FILINGS_SQL}
SELECT doc_id, i, section_id AS section_base_id, section_id || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS section_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY i) AS n FROM cand)""")
def section_numbers(spark, sf_dir):
    return parsing.numbered(parsing.candidates(filing_lines(spark, sf_dir))).select("doc_id", "i", "section_base_id", "section_id")


@query("section_slices", f"""WITH {FILINGS_SQL},
span AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_order FROM mono),
whole AS (SELECT doc_id, 'full_document' AS section_id, 0 AS section_order, -1 AS i, NULL AS stop FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM mono)),
every AS (SELECT doc_id, section_id, section_order, i, stop FROM span UNION ALL SELECT * FROM whole),
b AS (SELECT e.doc_id, section_id, section_order, array_to_string(list_slice(string_split(text, chr(10)), i + 2, coalesce(stop, 1000000000)), chr(10)) AS body FROM every e JOIN documents USING (doc_id))
SELECT doc_id, section_id, CAST(section_order AS INTEGER) AS section_order, md5(body) AS body_md5 FROM b WHERE regexp_matches(body, '\\S')""")
def section_slices(spark, sf_dir):
    lines = filing_lines(spark, sf_dir)
    kept = parsing.monotonic(parsing.selected(parsing.candidates(lines)))
    return parsing.slices(kept, fx.table(spark, sf_dir, "documents")).select("doc_id", "section_id", "section_order", _sha(F.col("body")).alias("body_md5"))


@query("block_classify", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(p, '[ \t]{2,}', ' ', 'g')) AS p FROM l)
SELECT doc_id, CASE WHEN length(p) < 500 AND regexp_matches(p, '^[(*\d†‡§¶]') THEN 'footnote' ELSE 'text' END AS block_type, count(*) AS n FROM b WHERE length(p) >= 30 GROUP BY ALL""")
def block_classify(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return parsing.blocks(docs).groupBy("doc_id", "block_type").agg(F.count(F.lit(1)).alias("n"))


@query("table_split", f"""WITH {ROWS_SQL.strip()},
lines AS (SELECT sup, list(t ORDER BY t) AS own FROM rows GROUP BY sup),
body AS (SELECT sup, own, len(regexp_extract_all(array_to_string(list_concat(['| Row | Net | Count |', '| --- | --- | --- |'], own), chr(10)), '\\w+|[^\\w\\s]')) AS total,
                len(regexp_extract_all(array_to_string(['| Row | Net | Count |', '| --- | --- | --- |'], chr(10)) || chr(10), '\\w+|[^\\w\\s]')) AS head,
                greatest(1, len(regexp_extract_all(array_to_string(own[1:10], chr(10)), '\\w+|[^\\w\\s]')) // least(10, len(own))) AS per FROM lines),
steps AS (SELECT *, CASE WHEN total <= 60 THEN len(own) ELSE greatest(1, (60 - head) // per) END AS step FROM body)
SELECT sup, CAST(k AS INTEGER) AS position, md5(array_to_string(list_concat(['| Row | Net | Count |', '| --- | --- | --- |'], own[k * step + 1 : k * step + step]), chr(10))) AS part_md5
FROM (SELECT *, unnest(range(0, CAST(ceil(len(own) / step) AS BIGINT))) AS k FROM steps)""")
def table_split(spark, sf_dir):
    # every number is a figure here, however small, so that no row is context
    head = F.array(F.lit("| Row | Net | Count |"), F.lit("| --- | --- | --- |"))
    tables = statement_rows(spark, sf_dir).groupBy("sup").agg(F.array_join(F.concat(head, F.sort_array(F.collect_list("text"))), "\n").alias("text"))
    parts = tables.select("sup", F.posexplode(chunking.table_parts(F.col("text"), 60, r"^-?\d+$")).alias("position", "part"))
    return parts.select("sup", "position", _sha(F.col("part")).alias("part_md5"))


@query("table_extract")
def table_extract(spark, sf_dir):
    cells = F.concat(F.lit("<tr><td>"), F.array_join(F.filter(F.split("text", r"\s*\|\s*"), lambda x: x != ""), "</td><td>"), F.lit("</td></tr>"))
    rows = statement_rows(spark, sf_dir).groupBy("sup").agg(F.array_join(F.sort_array(F.collect_list(cells)), "").alias("rows"))
    pages = rows.select("sup", F.concat(F.lit("<p>Before</p><table><tr><th>Row</th><th>Net</th><th>Count</th></tr>"), "rows", F.lit("</table><p>After</p>")).alias("html"))
    found = parsing.extract_tables(pages, "sup")
    return found.select("sup", F.size("tables").alias("n_tables"), F.size(F.get("tables", F.lit(0))["rows"]).alias("n_rows"), _sha(F.get("tables", F.lit(0))["markdown"]).alias("markdown_md5"))


@query("hashed_encoder")
def hashed_encoder(spark, sf_dir):
    return indexing.hashed(fx.table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", F.transform("dense", lambda x: F.round(x.cast("double"), 6)).alias("dense"))


TERMS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))".format
# Each benchmark item with the five documents that BM25 finds for it among all.
RUNS = f"""{fx.CHUNKS_SQL.strip()}, {fx.bm25_sql("chunks", "bm")},
runs AS (
  SELECT query_id AS item_id, question, question AS truth, text AS ctx
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM bm) JOIN chunks USING (chunk_id) JOIN questions USING (query_id) WHERE n <= 5),
g AS (SELECT item_id, any_value(question) AS question, any_value(truth) AS truth, string_agg(ctx, chr(10) ORDER BY ctx) AS joined, avg(CASE WHEN len(list_intersect({TERMS("truth")}, {TERMS("ctx")})) >= 0.5 * len({TERMS("truth")}) THEN 1.0 ELSE 0.0 END) AS cp FROM runs GROUP BY item_id)"""


def eval_runs(spark, sf_dir):
    rows, asked = fx.chunks(spark, sf_dir), fx.questions(spark, sf_dir)
    found = retrieval.looked_up(retrieval.sparse(rows, asked, 5), rows.select("chunk_id", "text"))
    found = found.groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("contexts")).join(asked.select("query_id", "question"), "query_id")
    return found.select(F.col("query_id").alias("item_id"), "question", F.col("question").alias("answer"), F.col("question").alias("ground_truth"), "contexts")


@query("eval_context_recall", f"""WITH {RUNS}
SELECT item_id, round(CAST(len(list_intersect({TERMS("truth")}, {TERMS("joined")})) AS DOUBLE) / len({TERMS("truth")}), 6) AS context_recall, round(CAST(cp AS DOUBLE), 6) AS context_precision FROM g""")
def eval_context_recall(spark, sf_dir):
    return evaluation.scored(eval_runs(spark, sf_dir)).select("item_id", "context_recall", "context_precision")


@query("eval_containment", "SELECT item_id, count(doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def eval_containment(spark, sf_dir):
    items = fx.table(spark, sf_dir, "benchmark")
    found = matching.containing(items, fx.table(spark, sf_dir, "documents"))
    return items.select("item_id").join(found, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))
