"""Evaluation of answers and contexts by lexical proxies; a judge may take their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as X

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def containment(a: Column | str, b: Column | str) -> Column:
    """The share of the distinct terms of a that b has; 0 for none."""
    x, y = F.array_distinct(X.terms(a)), X.terms(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(x)), F.lit(0.0))


def scored(runs: DataFrame, useful: float = 0.5) -> DataFrame:
    """runs (question, answer, contexts, ground_truth) with the four metrics, each from 0 to 1."""
    joined = F.array_join("contexts", "\n")
    good = F.size(F.filter("contexts", lambda c: containment(F.col("ground_truth"), c) >= useful))
    precision = F.coalesce(F.try_divide(good, F.size("contexts")), F.lit(0.0))
    values = (containment("answer", joined), containment("question", "answer"), precision, containment("ground_truth", joined))
    return runs.withColumns({m: F.round(v, 6) for m, v in zip(METRICS, values, strict=True)})


def summary(rows: DataFrame) -> DataFrame:
    """One row: the mean of each metric and their mean."""
    means = rows.agg(*(F.round(F.avg(m), 6).alias(m) for m in METRICS))
    return means.withColumn("overall", F.round(sum((F.col(m) for m in METRICS), F.lit(0.0)) / len(METRICS), 6))
