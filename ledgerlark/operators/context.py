"""Contexts of answers: grouping, token budgets, citations, merged sub-answers and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X

# Budgets in tokens, and what is said where there is nothing to say.
PER_SOURCE, TOTAL, PARENT_LEAST, PARENT_MARGIN = 1500, 8500, 300, 30
HISTORY_TURNS, HISTORY_CHARS, TITLE_CHARS = 3, 400, 60
NO_SOURCES = "I could not find relevant information in the available filings."


def within_budget(rows: DataFrame, tokens: str = "tokens", per: str = "query_id", order: str = "rank", most: int = TOTAL) -> DataFrame:
    """Sources in order until one would pass the budget; the first always stays. Tokens are never negative, so that the running
    sum grows and the filter ends where a loop would stop."""
    own = W.partitionBy(per).orderBy(order)
    rows = rows.withColumn("running", F.sum(tokens).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_place", F.row_number().over(own))
    return rows.where((F.col("running") <= most) | (F.col("_place") == 1)).drop("_place")


def grouped(rows: DataFrame, keys: list[str], per: str = "query_id", order: str = "rank", text: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """A source for each section of a question, in the order in which its first chunk was ranked, texts joined by blank lines; also: more aggregates."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n")
    return rows.groupBy(per, *keys).agg(F.min(order).alias("first"), joined.alias(text), F.max("score").alias("score"), *also)


def contexts(retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, index, keys, context, tokens, score): numbered sources within both budgets. A source that leaves enough of its own
    budget is followed by the beginning of its section."""
    rows = retrieved.withColumn("parent", F.coalesce("parent_text", F.lit("")))
    own = grouped(rows, keys, also=(F.max("parent").alias("parent"),))
    body = own.withColumn("body", X.truncated(X.without_noise("text"), PER_SOURCE))
    room = PER_SOURCE - X.token_count("body") - PARENT_MARGIN
    extra = F.when((room > PARENT_LEAST) & (F.col("parent") != "") & (F.col("parent") != F.col("text")), F.concat(F.lit("\n\n"), F.array_join(F.slice(F.split("parent", r"\s+"), F.lit(1), F.greatest(room, F.lit(1))), " "))).otherwise("")
    rows = body.withColumn("context", F.concat("body", extra)).withColumn("tokens", X.token_count("context"))
    kept = within_budget(rows, order="first")
    return kept.withColumn("index", F.row_number().over(W.partitionBy("query_id").orderBy("first"))).select("query_id", "index", *keys, "context", "tokens", F.round("score", 4).alias("score"))


def citations(sources: DataFrame, company: str = "company", ticker: str = "ticker", year: str = "fiscal_year", section: str = "section_name", kind: str = "chunk_type") -> DataFrame:
    """(query_id, citations): an array of structs in the order of the sources' numbers; at most a few for each question."""
    one = F.struct("index", F.col(company).alias("company"), F.col(ticker).alias("ticker"), F.col(year).alias("fiscal_year"), F.col(section).alias("section"), F.col(kind).alias("chunk_type"), F.round("score", 4).alias("score"))
    return sources.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("citations"))


def renumbered(answer: Column, offset: Column) -> Column:
    """The answer with offset added to every [n], in one pass: a new number is never taken for an old one."""
    parts = F.split(F.regexp_replace(answer, r"\[(\d+)\]", "\x01[$1\x01"), "\x01")
    shift = lambda p: F.when(p.rlike(r"^\[\d+$"), F.concat(F.lit("["), (F.substr(p, F.lit(2)).cast("long") + offset).cast("string"), F.lit("]"))).otherwise(p)
    return F.array_join(F.transform(parts, shift), "")


def merged(answers: DataFrame) -> DataFrame:
    """(query_id, ord, offset, answer) of sub-answers (query_id, ord, answer, n_citations), numbered on from those before."""
    before = F.sum("n_citations").over(W.partitionBy("query_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    rows = answers.withColumn("offset", F.coalesce(before, F.lit(0)))
    return rows.select("query_id", "ord", "offset", renumbered(F.col("answer"), F.col("offset")).alias("answer"))


def concatenated(answers: DataFrame) -> DataFrame:
    """Default synthesis: the sub-answers beneath their questions, in order."""
    part = F.concat(F.lit("**"), "question", F.lit("**\n"), "answer")
    return answers.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("answer"))


def extracted(sources: DataFrame) -> DataFrame:
    """Default generator: the first sentence or row of each source, with its number; a fixed text where there is none."""
    line = F.get(X.sentences(F.substring_index("context", "\n", 2)), F.lit(0))
    part = F.concat(F.trim(line), F.lit(" ["), F.col("index").cast("string"), F.lit("]"))
    return sources.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", part.alias("part")))), lambda x: x["part"]), "\n").alias("answer"))
