"""Command line: ingest, ask and evaluate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlark import ingestion
from ledgerlark.engine import Engine
from ledgerlark.operators import evaluation, routing
from ledgerlark.settings import Settings


def engine(spark: SparkSession, settings: Settings) -> Engine:
    chunks = spark.read.parquet(f"{settings.index_dir}/chunks")
    return Engine(chunks.drop("dense"), chunks.select("chunk_id", "dense"), spark.read.parquet(f"{settings.index_dir}/parents"), routing.companies(spark))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerlark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("--force", action="store_true", help="index also what is indexed")
    commands.add_parser("ask").add_argument("question")
    tests = commands.add_parser("evaluate")
    tests.add_argument("--test-set", required=True, help="JSON records of question and ground_truth")
    tests.add_argument("--output", help="folder for the rows")
    tests.add_argument("--limit", type=int, help="questions at most")
    own = parser.parse_args(args)
    spark, settings = SparkSession.builder.appName("ledgerlark").getOrCreate(), Settings.load()
    if own.command == "ingest":
        ingestion.run(spark, settings, force=own.force).show(truncate=False)
    elif own.command == "ask":
        rows = spark.createDataFrame([(1, own.question)], "query_id long, question string")
        for r in engine(spark, settings).ask(rows).collect():
            print(r["answer"], *(r["citations"] or []), sep="\n")
    else:
        asked = spark.read.schema("question string, ground_truth string").option("multiLine", True).json(own.test_set)
        asked = (asked.limit(own.limit) if own.limit else asked).withColumn("query_id", F.xxhash64("question"))
        told = engine(spark, settings).ask(asked.select("query_id", "question")).select("query_id", "answer")
        rows = evaluation.scored(asked.join(told, "query_id").withColumn("contexts", F.split("answer", "\n")))
        if own.output:
            rows.write.mode("overwrite").json(own.output)
        evaluation.summary(rows).show()


if __name__ == "__main__":
    main()
