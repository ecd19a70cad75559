"""From submission files to an index: what changed is parsed and stored, what was parsed is chunked and indexed, failures are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import chunking, indexing, lifecycle, parsing, routing
from ledgerlark.settings import Settings
from ledgerlark.sources import filings
from ledgerlark.tables import saved, scratch, stored

KEYS = ["ticker", "fiscal_year"]
#: How chunks lie within a collection, for filters on section and type.
CLUSTERED = ["section_name", "chunk_type", "chunk_id"]
NO_REPORT, NO_CHUNKS = "no annual report among its documents", "nothing to index"


def changed_files(spark: SparkSession, settings: Settings, tickers: list[str] | None = None) -> DataFrame:
    """(file_path, ticker, filing_type, accession_number, size, modified, text, details) of submissions under <ticker>/<type>/<accession>/ that the
    parsed store has not seen at that size and time. Files are listed without their contents, and of the contents only files as
    new as the oldest change are opened."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,json}")
    every = read.load([f"{settings.raw_dir}/{t}/*/*" for t in tickers] if tickers else f"{settings.raw_dir}/*/*/*")
    place = lambda back: F.element_at(F.split("path", "/"), -back)
    listed = every.where(F.col("path").endswith(".txt")).select(F.col("path").alias("file_path"), F.upper(place(4)).alias("ticker"), place(3).alias("filing_type"), place(2).alias("accession_number"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    seen = stored(spark, f"{settings.parsed_dir}/manifest")
    new = saved(listed if seen is None else listed.join(seen.select("file_path", "size", "modified"), ["file_path", "size", "modified"], "left_anti"))
    oldest = new.agg(F.min("modified")).first()[0]
    contents = every.where(F.col("path").endswith(".txt") & (F.col("modificationTime") >= F.lit(oldest))).select(F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    told = every.where(F.col("path").endswith("filing-details.json")).select(place(2).alias("accession_number"), F.upper(place(4)).alias("ticker"), F.make_valid_utf8(F.col("content").cast("string")).alias("details"))
    return new.join(contents, "file_path").join(told.groupBy("ticker", "accession_number").agg(F.max("details").alias("details")), ["ticker", "accession_number"], "left")


def filings_of(files: DataFrame, known: DataFrame) -> DataFrame:
    """files as filings (doc_id, ticker, company, sector, filing_type, fiscal_year, accession_number, file_path, size, modified, sha, html).

    The year comes from all that stands before the first document. Of several files of a company and year the one with the last accession number stays.
    html is null where no document is kept."""
    head = F.substring_index("text", "<DOCUMENT>", 1)
    rows = files.withColumn("fiscal_year", filings.fiscal_year(head, "details", "accession_number")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    last = rows.groupBy(*KEYS).agg(F.max_by("file_path", F.struct("accession_number", "file_path")).alias("file_path"))
    rows = rows.join(last, [*KEYS, "file_path"])
    html = filings.joined(filings.documents_of(rows.select("file_path", "text")))
    named = filings.manifest(rows, known).withColumn("doc_id", F.concat_ws("_", "ticker", F.col("fiscal_year").cast("string")))
    return named.join(rows.select("file_path", "size", "modified", "sha"), "file_path").join(html, "file_path", "left")


def parsed(docs: DataFrame, recover: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections (doc_id, section_id, title, section_order, body) and tables (doc_id, idx, markdown) of filings (doc_id, html), and errors (doc_id, error).

    Each embedded document is parsed by itself; tables are numbered through the filing. A filing of which a document fails has an error
    and neither sections nor tables; null and blank html is one, too."""
    parts = parsing.documents_of(docs.where(F.trim(X.text_of("html")) != "").select("doc_id", parsing.without_tags_of_filings("html").alias("html")))
    pages = saved(parsing.extract_tables(parts, also=("part",)))
    bad = pages.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "part").alias("error"))
    bad = saved(bad.unionByName(docs.where(F.trim(X.text_of("html")) == "").select("doc_id", F.lit(NO_REPORT).alias("error"))))
    good = saved(parsing.numbered_through(pages.join(bad.select("doc_id"), "doc_id", "left_anti")))
    return parsing.sections_of_parts(good, recover=recover), good.select("doc_id", F.inline("tables")).select("doc_id", "idx", "markdown"), bad


def parse(spark: SparkSession, settings: Settings, known: DataFrame | None = None, tickers: list[str] | None = None, recover: Callable | None = None) -> int:
    """Parse the filings that changed into parsed_dir: sections and tables by collection, and a log of what was parsed when, with counts and
    errors; returns the number of filings that were parsed now.

    A file is known by path, size and time, and its content by its hash: an untouched one is not opened, a touched one of equal content is not parsed, and
    neither is one that failed before and is the same. The log is written last, so that a run that ends before is done again."""
    with scratch(spark):
        docs = saved(filings_of(changed_files(spark, settings, tickers), routing.companies(spark) if known is None else known))
        log = stored(spark, f"{settings.parsed_dir}/manifest")
        seen = docs.select("doc_id", "sha").limit(0) if log is None else log.select("doc_id", "sha")
        new = saved(docs.join(seen, ["doc_id", "sha"], "left_anti"))
        sections, tables, bad = parsed(new, recover)
        sections, tables = saved(sections), saved(tables)
        named = new.select("doc_id", *KEYS)
        lifecycle.store_partitions(sections.join(named, "doc_id"), f"{settings.parsed_dir}/sections", KEYS)
        lifecycle.store_partitions(tables.join(named, "doc_id"), f"{settings.parsed_dir}/tables", KEYS)
        counts = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections")).join(tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables")), "doc_id", "left")
        same = docs.join(new.select("doc_id"), "doc_id", "left_anti").drop("html")
        rows = new.drop("html").join(counts, "doc_id", "left").join(bad, "doc_id", "left").withColumn("parsed", F.lit(True))
        if log is not None:  # touched files of equal content keep what the log says of that content
            before = log.groupBy("doc_id", "sha").agg(F.max_by(F.struct("sections", "tables", "error"), "at").alias("of"))
            rows = rows.unionByName(same.join(before, ["doc_id", "sha"]).select("*", "of.*").drop("of").withColumn("parsed", F.lit(False)))
        rows = rows.na.fill(0, ["sections", "tables"]).withColumn("at", F.current_timestamp())
        rows.write.mode("append").parquet(f"{settings.parsed_dir}/manifest")
        return new.count()


def manifest(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """The last entry of each filing in the parsed store's log."""
    log = stored(spark, f"{settings.parsed_dir}/manifest")
    return None if log is None else lifecycle.latest(log, ["doc_id"], "at")


def dead_letters(spark: SparkSession, settings: Settings) -> DataFrame:
    """(doc_id, file_path, stage, error) of filings that failed: in parsing, or because nothing of them could be indexed."""
    own, index = manifest(spark, settings), stored(spark, f"{settings.index_dir}/log")
    out = own.where("error is not null").select("doc_id", "file_path", F.lit("parse").alias("stage"), "error")
    if index is None:
        return out
    empty = lifecycle.latest(index, ["doc_id"], "at").where("chunks = 0").join(own.select("doc_id", "file_path"), "doc_id")
    return out.unionByName(empty.select("doc_id", "file_path", F.lit("chunk").alias("stage"), F.lit(NO_CHUNKS).alias("error")))


def chunked(docs: DataFrame, sections: DataFrame, tables: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of all blocks with running positions and ids that depend on where they stand."""
    blocks = parsing.blocks(sections).withColumnRenamed("position", "block").withColumnRenamed("title", "section_name")
    idx = F.regexp_extract("text", r"^<<<TABLE_(\d+)>>>$", 1)
    blocks = blocks.withColumn("idx", F.nullif(idx, F.lit("")).cast("int")).join(tables, ["doc_id", "idx"], "left")
    blocks = blocks.join(docs.select("doc_id", "company", "ticker", "filing_type", "fiscal_year"), "doc_id")
    keep = ["doc_id", "company", "ticker", "filing_type", "fiscal_year", "section_id", "section_name", "section_order", "block", "position", "chunk_type", "text", "token_count"]
    plain = chunking.text_chunks(blocks.where("idx is null").drop("idx", "markdown").withColumnRenamed("block_type", "chunk_type"), "text", settings.max_chunk_tokens, settings.chunk_overlap)
    boxed = chunking.enriched(blocks.where("markdown is not null").drop("idx", "text").withColumnRenamed("block_type", "chunk_type"), "markdown", settings.max_chunk_tokens)
    rows = plain.withColumnRenamed("chunk_text", "text").select(*keep).unionByName(boxed.withColumnRenamed("chunk_text", "text").select(*keep))
    return chunking.identified(rows.withColumnRenamed("position", "part"), ["section_order", "block", "part"])


def index(spark: SparkSession, settings: Settings, force: bool = False, tickers: list[str] | None = None, encoder: Callable[[DataFrame], DataFrame] = indexing.hashed) -> DataFrame:
    """Index the stored filings whose content the index does not have (all of them if forced); returns (ticker, fiscal_year) of those written.

    Sections that are asked about most are searchable first: they are written before the rest, which replaces the collection whole. The index's log
    is written last, with the number of chunks."""
    with scratch(spark) as kept:
        docs = manifest(spark, settings)
        docs = docs.where("error is null") if tickers is None else docs.where(F.col("error").isNull() & F.col("ticker").isin(*tickers))
        log = stored(spark, f"{settings.index_dir}/log")
        new = docs if force or log is None else docs.join(lifecycle.latest(log, ["doc_id"], "at").select("doc_id", "sha"), ["doc_id", "sha"], "left_anti")
        new = saved(new)
        if new.isEmpty():
            return kept(new.select(*KEYS))
        own = [stored(spark, f"{settings.parsed_dir}/{name}") for name in ("sections", "tables")]
        sections, tables = (None if t is None else t.join(new.select("doc_id"), "doc_id", "left_semi").drop(*KEYS) for t in own)
        tables = spark.createDataFrame([], "doc_id string, idx int, markdown string") if tables is None else tables
        rows = saved(lifecycle.prioritised(saved(chunked(new, sections, tables, settings)), KEYS))
        parents = sections.join(new.select("doc_id", *KEYS), "doc_id").select(*KEYS, "section_id", F.col("body").alias("parent_text"))
        lifecycle.store_partitions(parents, f"{settings.index_dir}/parents", KEYS)
        path = f"{settings.index_dir}/chunks"
        first = saved(encoder(rows.where("load = 1").drop("load")))
        lifecycle.store_partitions(first, path, KEYS, CLUSTERED, ["chunk_id"])
        rest = rows.where("load = 2")
        if not rest.isEmpty():
            some = rest.select(*KEYS).distinct()
            lifecycle.store_partitions(first.join(some, KEYS, "left_semi").unionByName(encoder(rest.drop("load"))), path, KEYS, CLUSTERED, ["chunk_id"])
        counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
        told = new.select("doc_id", *KEYS, "sha").join(counts, "doc_id", "left").na.fill(0, ["chunks"]).withColumn("at", F.current_timestamp())
        told.write.mode("append").parquet(f"{settings.index_dir}/log")
        return kept(new.select(*KEYS))


def run(spark: SparkSession, settings: Settings, known: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Parse what changed under raw_dir and index what the index lacks; returns the collections written."""
    parse(spark, settings, known)
    return index(spark, settings, force)


def on_demand(spark: SparkSession, settings: Settings, requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(ticker, year, years, outcome) of requests (ticker, year; a null year means the last there is), after fetching what must be: the
    years that are indexed now, and indexed, fetched, year_not_available or failed.

    Companies that failed, and years that were not there, less than FAILURE_SECONDS ago are not tried again: failures are a table
    beside the index, written last. What is tried is parsed and indexed from the files of those companies alone, first the
    sections that are asked about most. One writer at a time: two runs at once may fetch alike, but write the same collections."""
    with scratch(spark) as kept:
        asked = saved(requests.where("ticker is not null").select(F.upper("ticker").alias("ticker"), F.col("year").cast("int").alias("year")).distinct())
        failures = f"{settings.index_dir}/failures"

        def state() -> DataFrame:
            log = stored(spark, f"{settings.index_dir}/log")
            if log is None:
                return asked.select("*", F.array().cast("array<int>").alias("years"))
            have = lifecycle.latest(log, ["doc_id"], "at").where("chunks > 0").groupBy("ticker").agg(F.sort_array(F.collect_set("fiscal_year")).alias("years"))
            return asked.join(have, "ticker", "left").withColumn("years", F.coalesce("years", F.array().cast("array<int>")))

        there = F.when(F.col("year").isNull(), F.size("years") > 0).otherwise(F.array_contains("years", F.col("year")))
        before = state()
        wanted = before.where(~there)
        past = stored(spark, failures)
        if past is not None:
            recent = past.where(F.col("ts") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(lifecycle.FAILURE_SECONDS)))
            wanted = wanted.join(recent.where("year is null").select("ticker").distinct(), "ticker", "left_anti").join(recent.select("ticker", "year").distinct(), ["ticker", "year"], "left_anti")
        tried = saved(wanted.select("ticker", "year"))
        tickers = [r["ticker"] for r in tried.select("ticker").distinct().collect()]
        if present := [t for t in tickers if _has_files(spark, settings, t)]:
            parse(spark, settings, known, present)
            index(spark, settings, tickers=present)
        mark = tried.select("ticker", F.coalesce("year", F.lit(-1)).alias("y"), F.lit(True).alias("tried"))
        found = state().withColumn("y", F.coalesce("year", F.lit(-1))).join(mark, ["ticker", "y"], "left").withColumn("tried", F.coalesce("tried", F.lit(False)))
        outcome = F.when(there, F.when(F.col("tried"), "fetched").otherwise("indexed")).when(F.size("years") == 0, "failed").otherwise("year_not_available")
        found = saved(found.withColumn("outcome", outcome))
        lost = found.where("tried and outcome in ('failed', 'year_not_available')")
        lost.select("ticker", F.when(F.col("outcome") != "failed", F.col("year")).alias("year"), F.current_timestamp().alias("ts")).distinct().write.mode("append").parquet(failures)
        return kept(found.select("ticker", "year", "years", "outcome"))


def fetching(spark: SparkSession, settings: Settings, known: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetch for Engine and routing.ensured(): on_demand(), with null years where a company could not be had."""
    years = F.when(F.col("outcome") != "failed", F.col("years")).alias("years")
    return lambda asked: on_demand(spark, settings, asked, known).select("ticker", "year", years)


def _has_files(spark: SparkSession, settings: Settings, ticker: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{settings.raw_dir}/{ticker}")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder))
