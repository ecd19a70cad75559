"""Queries of the table of points: upserts and deletions merged on reading, and counts of collections after a compaction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import functions as F

from ledgerlark.operators.points import Points, counted
from ledgerlark.plans import fixtures as fx
from ledgerlark.plans.registry import query
from ledgerlark.tables import deleted, saved, shared_dir


@contextmanager
def _store(spark, sf_dir) -> Iterator[Points]:
    """All chunks as a table of points, then three batches: every third chunk anew with the text of a later load, every fifth deleted, and every
    fifteenth put once more. Its files go at the end."""
    rows = fx.chunks(spark, sf_dir).select("chunk_id", *fx.KEYS, "section_id", "chunk_type", "text")
    points = Points(f"{shared_dir(spark)}/{uuid.uuid4().hex}", rows.schema, tuple(fx.KEYS), "chunk_id", ("section_id", "chunk_type"))
    try:
        points.replace(rows)
        loads = rows.where("chunk_id % 3 = 0").withColumn("load", F.explode(F.array(F.lit(2), F.lit(1))))
        points.put(loads.withColumn("text", F.concat_ws(" ", F.concat(F.lit("load "), F.col("load").cast("string")), "text")), "load")
        points.remove(rows.where("chunk_id % 5 = 0"))
        points.put(rows.where("chunk_id % 15 = 0").withColumns({"section_id": F.lit("again"), "chunk_type": F.lit("table")}))
        yield points
    finally:
        deleted(spark, points.path)


NOW_SQL = """now AS (
  SELECT chunk_id, source, lang, CASE WHEN chunk_id % 15 = 0 THEN 'again' ELSE section_id END AS section_id, CASE WHEN chunk_id % 15 = 0 THEN 'table' ELSE chunk_type END AS chunk_type,
         CASE WHEN chunk_id % 15 = 0 THEN text WHEN chunk_id % 3 = 0 THEN 'load 2' || coalesce(' ' || text, '') ELSE text END AS text
  FROM chunks WHERE chunk_id % 5 <> 0 OR chunk_id % 15 = 0)"""


@query("index_upsert", f"WITH {fx.CHUNKS_SQL}, {NOW_SQL} SELECT chunk_id, source, lang, section_id, chunk_type, md5(text) AS text_md5 FROM now")
def index_upsert(spark, sf_dir):
    with _store(spark, sf_dir) as points:
        return saved(points.rows(spark).select("chunk_id", *fx.KEYS, "section_id", "chunk_type", F.md5(F.col("text").cast("binary")).alias("text_md5")))


@query("index_counts", f"""WITH {fx.CHUNKS_SQL}, {NOW_SQL}
SELECT source, lang, count(*) AS points, count(DISTINCT section_id) AS sections, count(*) FILTER (WHERE chunk_type = 'table') AS tables, count(*) FILTER (WHERE chunk_type = 'text') AS texts,
       count(*) FILTER (WHERE trim(text, ' ') <> '') AS filled FROM now GROUP BY source, lang""")
def index_counts(spark, sf_dir):
    with _store(spark, sf_dir) as points:
        points.compact(spark)
        return saved(counted(points.rows(spark), fx.KEYS))
