"""Answers from retrieved chunks: one broadened retry of refusals, and sub-answers put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import context, retrieval
from ledgerlark.tables import saved

Respond = Callable[[DataFrame], DataFrame]
# What is said where there is nothing to say.
OUT_OF_SCOPE = "This question is outside of what the available annual reports cover."
WHICH_COMPANY = "Which company do you mean? Answers come from the indexed annual reports of a company that the question names."
NOTHING_FOUND = "The available documents hold nothing about this question."


def with_retry(asked: DataFrame, respond: Respond) -> DataFrame:
    """What respond gives for each question (query_id, k, focus and others), with retried and mended.

    respond returns (query_id, answer, ...). Questions whose answer is a refusal, or that have none, are asked once more, and they alone: with twice
    the results, 15 at most, and without a focus. The second answer stands where it is no refusal. The first answers, a row for
    each question, are written, so that the second pass doesn't begin by making them again."""
    first = saved(asked.select("query_id").join(respond(asked), "query_id", "left"))
    told = [c for c in first.columns if c != "query_id"]
    refused = first.where(F.col("answer").isNull() | X.is_refusal("answer")).select("query_id")
    if refused.isEmpty():
        return first.withColumn("retried", F.lit(False)).withColumn("mended", F.lit(False))
    again = asked.join(refused, "query_id", "left_semi").withColumn("k", retrieval.retry_k(F.col("k"))).withColumn("focus", F.lit("other"))
    second = saved(respond(saved(again)))
    good = second.where(F.col("answer").isNotNull() & ~X.is_refusal("answer")).select("query_id", F.struct(*told).alias("better"))
    rows = first.join(refused.withColumn("retried", F.lit(True)), "query_id", "left").join(good, "query_id", "left")
    mended = F.col("better").isNotNull()
    chosen = [F.when(mended, F.col(f"better.{c}")).otherwise(F.col(c)).alias(c) for c in told]
    return rows.select("query_id", *chosen, F.coalesce("retried", F.lit(False)).alias("retried"), mended.alias("mended"))


def synthesised(asked: DataFrame, answers: DataFrame, write: Respond | None = None) -> DataFrame:
    """(query_id, answer, citations, fell_back) of questions (query_id, question) with sub-answers (query_id, ord, ticker, year, question,
    answer, citations).

    Sub-answers without sources are left out; the others come in their order, citations numbered on from one to the next in text and list
    alike. write gets (query_id, question, text), the sub-answers beneath their headings, and returns (query_id, answer); where it returns
    nothing for a question, as on a failure, the sub-answers themselves are the answer. A question left without any gets a fixed one."""
    used = answers.where(F.col("answer").isNotNull() & (F.size("citations") > 0)).withColumn("n_citations", F.size("citations"))
    numbered = context.merged(used).join(used.select("query_id", "ord", "ticker", "year", "question", "citations"), ["query_id", "ord"])
    moved = F.transform("citations", lambda c: c.withField("index", c["index"] + F.col("offset").cast("int")))
    head = F.concat(F.lit("### "), "ticker", F.lit(" FY"), F.col("year").cast("string"), F.lit("\n"), "question", F.lit("\n\n"), "answer")
    whole = numbered.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", head.alias("text"), moved.alias("citations")))).alias("parts"))
    whole = whole.select("query_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), F.flatten(F.transform("parts", lambda p: p["citations"])).alias("citations"))
    rows = asked.select("query_id", "question").join(whole, "query_id", "left")
    if write is None:
        rows = rows.withColumn("written", F.lit(None).cast("string"))
    else:
        rows = saved(rows)
        rows = rows.join(write(rows.where("text is not null").select("query_id", "question", "text")).select("query_id", F.col("answer").alias("written")), "query_id", "left")
    return rows.select("query_id", F.coalesce("written", "text", F.lit(NOTHING_FOUND)).alias("answer"), "citations", (F.col("written").isNull() & F.col("text").isNotNull()).alias("fell_back"))


def by_model(model: Callable[[str, str], str]) -> Respond:
    """A write for synthesised() from a function of (question, text): a failure or empty reply leaves that question alone unanswered."""

    def write(rows: DataFrame) -> DataFrame:
        def work(batches):
            import pandas as pd

            def one(question: str, text: str) -> str | None:
                try:
                    return (model(question, text) or "").strip() or None
                except Exception:
                    return None

            for frame in batches:
                yield pd.DataFrame({"query_id": frame["query_id"], "answer": [one(q, t) for q, t in zip(frame["question"], frame["text"], strict=True)]})

        return rows.mapInPandas(work, f"query_id {dict(rows.dtypes)['query_id']}, answer string")

    return write


def failures(failed: str = "failed_lookups", ingest: str = "ingest_failed", years: str = "year_not_available") -> tuple[Column, Column]:
    """What a question is told about companies that could not be found, fetched or had no such year: as the whole answer, and as a note
    beneath one that covers the others; empty where there are none."""
    names = lambda c: F.array_join(c, ", ")
    has = lambda c: F.size(c) > 0
    full = F.concat_ws(" ", F.when(has(failed), F.concat(F.lit("No annual reports are known for "), names(failed), F.lit("."))), F.when(has(ingest), F.concat(F.lit("The reports of "), names(ingest), F.lit(" could not be fetched or indexed just now."))), F.when(has(years), F.concat(F.lit("Not available for that year: "), F.array_join(years, "; "), F.lit("."))))
    short = F.concat_ws("; ", F.when(has(failed), F.concat(F.lit("no reports known for "), names(failed))), F.when(has(ingest), F.concat(F.lit("not fetched or indexed: "), names(ingest))), F.when(has(years), F.concat(F.lit("not that year: "), F.array_join(years, "; "))))
    return full, F.when(short != "", F.concat(F.lit("\n\n*Note: this covers only the companies that were found ("), short, F.lit(").*"))).otherwise("")
