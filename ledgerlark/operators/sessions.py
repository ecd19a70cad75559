"""Chat history: sessions, turns, reviews and prompts' histories. Changes are new tables: a keyed anti join and a union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.operators.context import HISTORY_CHARS, HISTORY_TURNS, TITLE_CHARS


def title(question: str | Column) -> Column:
    """The first 60 characters of a question, marked where it was cut."""
    q = F.trim(F.col(question) if isinstance(question, str) else question)
    return F.when(F.length(q) > TITLE_CHARS, F.concat(F.left(q, F.lit(TITLE_CHARS)), F.lit("…"))).otherwise(q)


def session_list(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their numbers of turns, also those without any; last touched first."""
    counts = turns.groupBy(F.col("session_id").alias("id")).agg(F.count("id").alias("turn_count"))
    return sessions.join(counts, "id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0))).orderBy(F.desc("updated_at"), "id")


def review_list(turns: DataFrame, sessions: DataFrame, which: str = "all") -> DataFrame:
    """Turns with their sessions' titles: correct, incorrect or unreviewed ones; any other word means all."""
    rows = turns.join(sessions.select(F.col("id").alias("session_id"), "title"), "session_id")
    test = {"correct": F.col("is_correct") == 1, "incorrect": F.col("is_correct") == 0, "unreviewed": F.col("is_correct").isNull()}.get(which)
    return rows if test is None else rows.where(test)


def histories(turns: DataFrame, k: int = HISTORY_TURNS) -> DataFrame:
    """(session_id, history): the last k turns in order, answers cut at 400 characters, parted by ---."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")))
    last = turns.withColumn("back", rank).where(F.col("back") <= k)
    part = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.left(F.coalesce("answer", F.lit("")), F.lit(HISTORY_CHARS)))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), part.alias("part"))))
    return last.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n---\n").alias("history"))


def with_history(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """Questions of sessions with their history before them."""
    rows = questions.join(histories(turns), "session_id", "left")
    return rows.withColumn("question", F.when(F.col("history").isNotNull(), F.concat(F.lit("Earlier in this conversation:\n"), "history", F.lit("\n\n"), "question")).otherwise(F.col("question"))).drop("history")


def inserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with rows added; rows whose key it has take that row's place."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def touched(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions whose updated_at is that of their latest new turn, if later."""
    latest = turns.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("latest"))
    return sessions.join(latest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "latest")).drop("latest").select(*sessions.columns)


def deleted(sessions: DataFrame, turns: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of gone (id) and, with them, their turns."""
    return sessions.join(gone, "id", "left_anti"), turns.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti").select(*turns.columns)


def reviewed(turns: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns with the marks (id, is_correct; null clears) set, and the marks whose turn does not exist."""
    rows = turns.join(marks.select("id", F.col("is_correct").alias("mark"), F.lit(True).alias("has")), "id", "left")
    rows = rows.withColumn("is_correct", F.when(F.col("has"), F.col("mark")).otherwise(F.col("is_correct"))).select(*turns.columns)
    return rows, marks.join(turns.select("id"), "id", "left_anti")
