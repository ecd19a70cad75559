"""Questions to cited answers: the operators put together, with models as plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import answering, context, retrieval, routing, sessions
from ledgerlark.operators.indexing import hashed
from ledgerlark.tables import saved, scratch

LISTS = ["failed_lookups", "ingest_failed", "year_not_available"]


@dataclass
class Engine:
    """chunks: chunk_id, text, company, ticker, fiscal_year, section_id, section_name, chunk_type, position; vectors: chunk_id, dense;
    parents: ticker, fiscal_year, section_id, parent_text; companies: ticker, name, sector; registry: ticker, title, ord. Every plug-in
    has a default that needs no model.

    classify: questions and companies to types, tickers, years, focus and unresolved names. decompose: questions over several companies
    or years to sub-questions (query_id, ord, question, ticker, year). answer: sources to (query_id, answer). write: see
    answering.synthesised(). fetch: see routing.ensured()."""

    chunks: DataFrame
    vectors: DataFrame
    parents: DataFrame
    companies: DataFrame
    registry: DataFrame | None = None
    classify: Callable[[DataFrame, DataFrame], DataFrame] = routing.classified
    encode: Callable[[DataFrame, str], DataFrame] = hashed
    rerank: Callable[[str, str], Column] = retrieval.overlap_score
    decompose: Callable[[DataFrame, DataFrame], DataFrame] = routing.decomposed
    answer: Callable[[DataFrame], DataFrame] = context.extracted
    write: Callable[[DataFrame], DataFrame] | None = None
    fetch: Callable[[DataFrame], DataFrame] | None = None
    keys: list[str] = field(default_factory=lambda: ["ticker", "fiscal_year"])

    def retrieve(self, asked: DataFrame, targets: DataFrame) -> DataFrame:
        """Results of questions (query_id, question, focus, k), each in its own collections alone (query_id, ticker, fiscal_year)."""
        rows = self.encode(asked, "question")
        scope = self.chunks.join(targets.select(*self.keys).distinct(), self.keys, "left_semi")  # collections nobody asks about are not searched
        found = retrieval.candidates(retrieval.passes(scope, self.vectors, rows, self.keys, targets)).select("query_id", "chunk_id")
        met = found.join(scope, "chunk_id").join(asked.select("query_id", "question", "focus", "k"), "query_id")
        met = met.withColumn("score", F.round(self.rerank("question", "text") + retrieval.boost(), 6))
        kept = retrieval.diverse(met, [*self.keys, "section_name", "chunk_type"], F.col("k"))
        return retrieval.with_parents(kept, self.parents, [*self.keys, "section_id"])

    def respond(self, asked: DataFrame, targets: DataFrame) -> DataFrame:
        """(query_id, answer, citations) of each question; a fixed answer where nothing was found."""
        sources = saved(context.contexts(self.retrieve(asked, targets), [*self.keys, "company", "section_name", "chunk_type"]))
        told = asked.select("query_id").join(self.answer(sources).select("query_id", "answer"), "query_id", "left").join(context.citations(sources), "query_id", "left")
        return told.withColumn("answer", F.when(F.col("citations").isNull(), context.NO_SOURCES).otherwise(F.col("answer")))

    def ask(self, questions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
        """(query_id, query_type, focus, route, answer, citations, refused, retried, mended and three lists of what failed), as a table, of questions
        (query_id, question, and session_id where turns are given).

        Companies that a question names are resolved and, where they are not indexed, fetched. A question of one company is answered
        in its collections, once more and wider if that is refused; one of several companies or years by sub-answers. What
        could not be found is the answer, or a note beneath it. Earlier turns of a session go before its question."""
        with scratch(questions.sparkSession) as kept:
            said = questions if turns is None else sessions.with_history(questions, turns)
            have = self.chunks.select(*self.keys).distinct()
            registry = self.registry if self.registry is not None else self.companies.select("ticker", F.col("name").alias("title"), F.lit(0).alias("ord"))
            routed = saved(routing.ensured(saved(self.classify(said, self.companies)), registry, self.companies, have, self.fetch))
            named = lambda rows: rows.select("query_id", F.inline("targets")).withColumnRenamed("year", "fiscal_year")

            single = saved(routed.where("route = 'single'").select("query_id", "question", "focus", retrieval.adaptive_k(F.col("tickers"), F.col("years")).alias("k")))
            places = saved(named(routed.where("route = 'single'")))
            one = answering.with_retry(single, lambda asked: self.respond(asked, places.join(asked.select("query_id"), "query_id", "left_semi")))

            many = routed.where("route = 'synthesis'")
            subs = self.decompose(many, self.companies).join(many.select("query_id", "focus"), "query_id")
            subs = saved(subs.select(F.concat_ws("|", F.col("query_id").cast("string"), F.col("ord").cast("string")).alias("sub_id"), "query_id", "ord", "question", "ticker", "year", "focus"))
            asked = subs.select(F.col("sub_id").alias("query_id"), "question", "focus", F.lit(3).alias("k"))
            told = self.respond(asked, subs.select(F.col("sub_id").alias("query_id"), "ticker", F.col("year").alias("fiscal_year")))
            parts = subs.join(told.withColumnRenamed("query_id", "sub_id"), "sub_id")
            both = answering.synthesised(many, parts, self.write).select("query_id", "answer", "citations", F.lit(False).alias("retried"), F.lit(False).alias("mended"))

            out = routed.select("query_id", "query_type", "focus", "route", *LISTS).join(one.unionByName(both), "query_id", "left")
            whole, note = answering.failures()
            fixed = F.when(F.col("route") == "out_of_scope", answering.OUT_OF_SCOPE).when(F.col("route") == "unresolved_company", whole).otherwise(answering.WHICH_COMPANY)
            answered = F.col("route").isin("single", "synthesis")
            out = out.withColumn("refused", answered & X.is_refusal("answer")).withColumn("answer", F.when(answered, F.concat("answer", note)).otherwise(fixed))
            return kept(out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("retried", "mended")}))
