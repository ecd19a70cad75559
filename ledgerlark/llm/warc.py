"""WARC archives: writing captures as concurrent records, reading records, and assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import integer_id, saved, scratch

CRLF = "\r\n"
#: Records of a file: three for each capture, so that a reader holds a few MB at a time.
FILE_RECORDS = 3000
DATE = "2024-01-01T00:00:00Z"


def _headed(version: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record or message: version line, the fields that are not null, an empty line and the block."""
    lines = [F.lit(version), *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields)]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _record(kind: Column, key: Column, uri: Column, media: Column, block: Column, more: list[tuple[str, Column]]) -> Column:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<"), key, F.lit(">"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *more]
    return _headed("WARC/1.1", [*fields, ("Content-Type", media), ("Content-Length", F.octet_length(block))], block)


def _key(*parts: Column) -> Column:
    """A record id that the record's content gives, so that a task that runs again writes the same ids."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> None:
    """Write a request, a response or revisit, and a metadata record for each row, as gzipped WARC files under path.

    Of the rows with equal payloads of at least `least` bytes, the one with the smallest id is a response and the
    others revisit it: their records name it and carry no payload. Smaller payloads are always responses, and so
    are all rows that repeat the smallest id, url and payload. A null html is an empty payload, a null url
    about:blank; a row with a null id comes after all others. Blanks and control characters of a url are percent-encoded.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(integer_id(pages, id_col).alias("page_id"), uri.alias("uri"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size"))
    rows = rows.withColumn("key", _key(F.col("page_id"), F.col("uri"), F.col("digest")))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")
    same = rows.where(F.col("size") >= least).select("digest", "key", "page_id")
    found = same.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", F.col("first.key").alias("first_key"))
    revisits = same.join(found, "digest").where("key != first_key").select("key", "first_key").distinct()
    rows = rows.join(revisits, "key", "left")  # bodies meet by their own keys, so that no hot payload gathers them
    again = F.col("first_key").isNotNull()
    key, uri = F.col("key"), F.col("uri")
    angled = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    main = _headed("HTTP/1.1 200 OK", [("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size"))], F.when(again, "").otherwise(F.col("body")))
    asked = _headed("GET / HTTP/1.1", [("Host", F.coalesce(F.nullif(F.regexp_extract("uri", r"^[a-z]+://([^/?#]+)", 1), F.lit("")), F.lit("localhost")))], F.lit(""))
    told = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    seen = [
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(again, angled(F.col("first_key")))),
    ]
    beside = [("WARC-Concurrent-To", angled(key))]
    http = lambda kind: F.lit(f"application/http; msgtype={kind}")
    records = F.array(
        _record(F.lit("request"), _key(key, F.lit("request")), uri, http("request"), asked, beside),
        _record(F.when(again, "revisit").otherwise("response"), key, uri, http("response"), main, seen),
        _record(F.lit("metadata"), _key(key, F.lit("metadata")), uri, F.lit("application/warc-fields"), told, beside),
    )
    lines = rows.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _until_blank(f: io.BufferedIOBase) -> tuple[str, dict[str, str]] | None:
    """The first line and the fields of a head; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    first, fields = line.decode().strip(), {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def parsed(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields and the block of each record of an archive."""
    while head := _until_blank(f):
        version, fields = head
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        size = int(fields["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise ValueError("a record ends before its length")
        yield fields, block


RECORD = "kind string, key string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives under path. payload: whether to return the payloads themselves.

    A response's length and digest are taken from the payload as read; a revisit has the digest of its head and no
    length. page_id is a metadata record's. A folder without archives gives no rows.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if " long" in x else pa.binary() if " binary" in x else pa.string() for x in RECORD.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        bare = lambda x: x.strip("<>") if x else None
        for own in batches:
            for k in range(own.num_rows):
                content = own.column("content")[k].as_py()
                source = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows, held = [], 0
                for fields, block in parsed(io.BufferedReader(source)):
                    kind = fields["warc-type"]
                    page = size = digest = body = None
                    if kind in ("response", "revisit"):
                        body = block.partition(b"\r\n\r\n")[2]
                        size, digest = (len(body), hashlib.sha256(body).hexdigest()) if kind == "response" else (None, fields["warc-payload-digest"].removeprefix("sha256:"))
                    elif kind == "metadata":
                        told = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        page = int(told["page-id"]) if told.get("page-id") else None
                    rows.append((kind, bare(fields["warc-record-id"]), bare(fields.get("warc-concurrent-to")), bare(fields.get("warc-refers-to")), fields.get("warc-target-uri"), page, size, digest, body if payload and kind == "response" else None))
                    held += len(block)
                    if len(rows) >= 1000 or held > 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(work, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """(key, copies, page_id, request, response, metadata): one nested row for each capture.

    The records of a capture meet under the id that requests and metadata name as concurrent and that the
    response or revisit has as its own. Captures whose three records are all repeated are one row with a number of copies, so
    that no group grows with them. A revisit's response carries the length of the one that it refers to; a capture
    without a response or revisit has a null one.
    """
    record = F.struct("key", "uri", "refers_to", "kind", "payload_bytes", "payload_digest", "payload")
    own = records.withColumn("capture", F.coalesce("concurrent_to", "key"))
    main = F.col("kind").isin("response", "revisit")
    met = own.groupBy("capture").agg(
        F.greatest(F.count_if(main), F.lit(1)).alias("copies"), F.max("page_id").alias("page_id"), F.max(F.when(F.col("kind") == "request", F.struct("key", "uri"))).alias("request"),
        F.max(F.when(main, record)).alias("response"), F.max(F.when(F.col("kind") == "metadata", F.struct("key", "page_id"))).alias("metadata"),
    )
    return met.withColumnRenamed("capture", "key")


def with_references(met: DataFrame, parts: int = 8192, least: int = 8) -> DataFrame:
    """met (of transactions(), written) with first_page and first_bytes, those of the response that a revisit refers to.

    A response with more than a `parts`-th of all revisits, or `least` of them, is hot: there are at most `parts` of these, whose list goes to all tasks.
    Its revisits are dealt out by their own keys, and it is copied to as many places, so that no task meets them all."""
    again = F.col("response.kind") == "revisit"
    refers = F.coalesce("response.refers_to", "key")  # what refers to nothing goes by its own key: null keys would all meet in one task
    many = met.where(again).groupBy(refers.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    total = met.where(again).count()
    limit = max(least, -(-total // parts))
    hot = F.broadcast(saved(many.where(F.col("n") > limit).select("first", F.ceil(F.col("n") / limit).cast("int").alias("places"))))
    full = met.where(F.col("response.kind") == "response").select(F.col("key").alias("first"), F.col("page_id").alias("first_page"), F.col("response.payload_bytes").alias("first_bytes"))
    full = full.join(hot, "first", "left").withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")
    asked = met.withColumn("first", refers).join(hot, "first", "left").withColumn("place", F.when(again, F.pmod(F.xxhash64("key"), F.coalesce("places", F.lit(1)))).otherwise(0).cast("int")).drop("places")
    return asked.join(full, ["first", "place"], "left").withColumn("first_page", F.when(again, F.col("first_page"))).drop("first", "place")


def captures(pages: DataFrame, path: str, least: int = 100, payload: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives under path, read them back and assemble a nested row for each page, as a table.

    Adds payload_bytes, payload_digest, record_type and refers_to (the page of the response) of the full payload. A file is read whole by
    one task, so that 1,000 captures must stay below the 2 GB that a cell holds: longer pages than 2 MB on average need fewer. An empty table gives no rows.
    """
    with scratch(pages.sparkSession) as kept:
        write_archives(pages, path, id_col, url_col, html_col, least)
        met = with_references(saved(transactions(read_records(pages.sparkSession, path, payload))))
        met = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        return kept(met.select(
            "page_id", "key", "request", "response", "metadata", F.coalesce("response.payload_bytes", "first_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.kind").alias("record_type"), F.col("first_page").alias("refers_to"),
        ))
