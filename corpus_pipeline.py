"""The corpus pipeline: quality rules, toxicity, line dedup, SimHash near-dedup and packing.

Each stage takes (spark, docs, sf_dir) and all but the last return the columns of documents. A stage's result is
written to the shared folder and reread by the next one. No stage depends on the scale of its input: all rows and whole
texts, of any length, pass through each; an empty table gives no rows; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import linededup, packing, quality, simhash, toxicity
from ledgerlark.llm.common import dropped, scratch

TOXIC = 0.7
LINE_DOCS = 10
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within every bound of the threshold table; null and empty texts fail its least length."""
    return quality.passing(docs)


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model fitted on the labels of those whose crc32 modulo 3 is not 1.

    Null and empty texts have the score of no words; repeated rows go or stay together; a score of 0.7 goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    scored = toxicity.scored(docs, model)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < TOXIC).select(*(F.col(f"`{c}`") for c in docs.columns))


def common_lines_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more different texts have; n_chars follows the text.

    Rows of equal texts count as one text, so that a text of many copies keeps its lines. A null text becomes the empty text.
    """
    kept = linededup.without_common_lines(docs, min_docs=LINE_DOCS, copies=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by similarities of 0.8 or more over runs of five words.

    Null, empty and blank texts are copies of one another; of rows that repeat an id the least stays; rows without an id all stay.
    """
    return simhash.kept_one_of_each(docs, shingle=5, similarity=SIMILARITY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of at most 1024 ids. A null or empty text is one piece of one id; repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxic_removed),
    ("line_dedup", common_lines_removed),
    ("simhash_dedup", near_copies_removed),
    ("packing", packed),
]

#: Toxicity, SimHash and packing have no equal in SQL; tests/llm compares the stages with brute-force versions, one by one and in a row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir))
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
