"""Filings on disk: submission containers, primary documents, fiscal years, manifests and registries."""

from __future__ import annotations

import logging
import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.tables import deleted

log = logging.getLogger(__name__)

# Document types that are kept, the mark between embedded documents, and sizes.
KEPT_TYPES = ("10-K", "10-K405", "10-KSB", "EX-13")
LEAST_BYTES, UNKNOWN_YEAR, REGISTRY_DAYS = 1000, 2023, 7


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text) of whole submission files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def documents_of(files: DataFrame, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, seq, type, body) of the documents of a submission whose type begins like an annual report's or its exhibit."""
    rows = files.select(key, F.posexplode(F.regexp_extract_all(X.text_of(text), F.lit(r"(?s)<DOCUMENT>.*?</DOCUMENT>"), F.lit(0))).alias("seq", "doc"))
    rows = rows.withColumn("type", F.trim(F.regexp_extract("doc", r"<TYPE>([^\r\n<]*)", 1))).withColumn("body", F.regexp_extract("doc", r"(?s)<TEXT>(.*?)</TEXT>", 1))
    rows = rows.withColumn("body", F.trim(F.regexp_replace("body", r"(?is)^\s*<XBRL>|</XBRL>\s*$", "")))
    kept = F.exists(F.array(*map(F.lit, KEPT_TYPES)), lambda t: F.startswith(F.upper("type"), t))
    return rows.where(kept & (F.col("body") != "")).select(key, "seq", "type", "body")


def joined(documents: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, html): the kept documents of a submission in order, parted by a mark that names their types."""
    part = F.concat(F.lit("<!-- ===== embedded document: "), "type", F.lit(" ===== -->\n"), "body")
    ordered = F.sort_array(F.collect_list(F.struct("seq", part.alias("part"))))
    return documents.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("html"))


def primary(files: DataFrame, folder: str = "folder") -> DataFrame:
    """The main document of each folder of (folder, path, length): an earlier extract, else the longest page that is no
    index, each of over 1,000 bytes, else the submission itself."""
    name = F.lower(F.substring_index("path", "/", -1))
    page, index = name.rlike(r"\.html?$"), F.contains(name, F.lit("index"))
    big = F.col("length") > LEAST_BYTES
    kind = F.when(name.rlike(r"^primary[-_]document\.html?$") & big, 0).when(page & ~index & big, 1).when(F.contains(name, F.lit("submission")), 2)
    place = F.row_number().over(W.partitionBy(folder).orderBy("kind", F.desc("length"), "path"))
    return files.withColumn("kind", kind).where("kind is not null").withColumn("place", place).where("place = 1").drop("place")


def fiscal_year(header: str | Column, details: str | Column, accession: str | Column) -> Column:
    """The year of the period of report, of the details' report date, or the one before the accession number's, else 2023."""
    period = F.nullif(F.regexp_extract(X.text_of(header), r"(?i)CONFORMED PERIOD OF REPORT:\s*(\d{4})\d{4}", 1), F.lit(""))
    told = F.nullif(F.left(F.coalesce(F.get_json_object(X.text_of(details), "$.reportDate"), F.lit("")), F.lit(4)), F.lit(""))
    yy = F.nullif(F.regexp_extract(X.text_of(accession), r"^\d{10}-(\d{2})-\d+$", 1), F.lit(""))
    return F.coalesce(period.try_cast("int"), told.try_cast("int"), yy.try_cast("int") + 1999, F.lit(UNKNOWN_YEAR))


def manifest(filings: DataFrame, known: DataFrame) -> DataFrame:
    """Manifest rows of (ticker, filing_type, fiscal_year, accession_number, file_path): an unknown ticker is its own name, of sector Unknown."""
    rows = filings.join(known.select("ticker", F.col("name").alias("company"), "sector"), "ticker", "left")
    rows = rows.withColumn("company", F.coalesce("company", "ticker")).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return rows.select("ticker", "company", "sector", "filing_type", "fiscal_year", "accession_number", "file_path")


def load_manifest(spark: SparkSession, path: str, rebuild) -> DataFrame:
    """The stored manifest; where it is missing or empty, what rebuild() finds. Nothing at all is an error."""
    try:
        rows = spark.read.parquet(path)
        rows = rows if not rows.isEmpty() else rebuild()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        rows = rebuild()
    if rows.isEmpty():
        raise FileNotFoundError(f"no filings are known at {path}")
    return rows


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(ord, ticker, title, cik) of a JSON object of records, in its order; numbers are padded to ten digits."""
    record = "map<string, struct<cik_str: string, ticker: string, title: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", record)).alias("k", "r"))
    return rows.select(F.col("k").try_cast("int").alias("ord"), F.upper("r.ticker").alias("ticker"), "r.title", F.lpad("r.cik_str", 10, "0").alias("cik"))


def kept_registry(spark: SparkSession, source: str, cache: str, now: float | None = None, days: float = REGISTRY_DAYS) -> DataFrame:
    """The registry at source as a snapshot under cache that is younger than `days`; an older one is replaced from the source.

    Where the source cannot be read or holds no record, the last snapshot is used whatever its age, and where there is none the registry is empty.
    A snapshot is a folder that bears its second and is taken only when Spark has marked it complete; older ones go once a new one is. A
    ticker that stands several times has the last record, an empty one none. now: seconds, for tests."""
    now = time.time() if now is None else now
    ages = sorted(_snapshots(spark, cache))
    if ages and now - ages[-1] < days * 86400:
        return spark.read.parquet(f"{cache}/{ages[-1]}")
    try:
        rows = registry(spark, source).where("ticker <> ''")
        last = rows.groupBy("ticker").agg(F.max_by(F.struct("ord", "title", "cik"), "ord").alias("r")).select("r.ord", "ticker", "r.title", "r.cik")
        last.write.mode("overwrite").parquet(f"{cache}/{int(now)}")
        if spark.read.schema(last.schema).parquet(f"{cache}/{int(now)}").isEmpty():
            deleted(spark, f"{cache}/{int(now)}")
            raise ValueError(f"no record in {source}")
    except (PySparkException, ValueError) as e:
        log.warning("the registry at %s cannot be read: %s", source, str(e).partition("\n")[0])
        return spark.read.parquet(f"{cache}/{ages[-1]}") if ages else spark.createDataFrame([], "ord int, ticker string, title string, cik string")
    for age in ages:
        deleted(spark, f"{cache}/{age}")
    return spark.read.parquet(f"{cache}/{int(now)}")


def _snapshots(spark: SparkSession, cache: str) -> list[int]:
    """Seconds of the complete snapshots."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    whole = lambda n: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/{n}/_SUCCESS"))
    return [int(n) for n in names if n.isdigit() and whole(n)]


def parsed_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of documents or chunks; unreadable ones are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return rows.where("_bad is null").drop("_bad")
