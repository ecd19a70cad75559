"""Points of an index by collection: upserts and deletions by id as deltas, merged reads, compaction of what they touch, counts and sizes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.operators.lifecycle import store_partitions
from ledgerlark.tables import deleted, saved, scratch, stored

#: Collections that a compaction names to the scan of the files; beyond, it reads all files.
MOST_NAMED = 1000


@dataclass(frozen=True)
class Points:
    """A table of points under `path`: clustered files by collection (`keys`) and, beside them, deltas that are not merged yet.

    A point is known by its id within its collection: an equal id elsewhere is another point, and null is an id and a key like any other. Of a
    batch's rows with equal ids the last by `put`'s column stays, ties by their hash. Columns beyond the schema are dropped, and a batch must
    give the same rows when it is evaluated again. One writer at a time. Deltas win over files, so that a compaction that ends early is repeated without harm, and a batch that ends early is put again."""

    path: str
    schema: StructType
    keys: tuple[str, ...] = ("ticker", "fiscal_year")
    ident: str = "chunk_id"
    order: tuple[str, ...] = ("section_name", "chunk_type")

    @property
    def _ids(self) -> list[str]:
        return [*self.keys, self.ident]

    def _base(self, spark: SparkSession) -> DataFrame | None:
        # types of partition columns are the schema's, not what their names look like
        return None if stored(spark, f"{self.path}/base") is None else spark.read.schema(self.schema).parquet(f"{self.path}/base").select(*self.schema.names)

    def _deltas(self, spark: SparkSession) -> DataFrame | None:
        return stored(spark, f"{self.path}/deltas")

    def replace(self, rows: DataFrame) -> None:
        """Write the collections of rows whole, without a look at what their files hold. Their ids must be distinct; rows must not be read from path."""
        store_partitions(rows.select(*self.schema.names), f"{self.path}/base", list(self.keys), [*self.order, self.ident], [self.ident])

    def put(self, rows: DataFrame, last: str | None = None) -> None:
        """Insert or replace points: one more delta; files of the collections are not touched."""
        names = self.schema.names
        free = [c for c in names if c not in self._ids]
        at = F.struct(*([F.col(last)] if last else []), F.xxhash64(*map(F.col, names)))
        once = rows.groupBy(*self._ids).agg(F.max_by(F.struct(*free), at).alias("_row")).select(*self._ids, "_row.*")
        self._append(once.select(*names, F.lit(False).alias("_gone")))

    def remove(self, ids: DataFrame) -> None:
        """Delete points by (keys, id); unknown ones are ignored."""
        free = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self._ids]
        self._append(ids.select(*self._ids).distinct().select(*self._ids, *free, F.lit(True).alias("_gone")).select(*self.schema.names, "_gone"))

    def _append(self, rows: DataFrame) -> None:
        seen = self._deltas(rows.sparkSession)
        load = 1 if seen is None else 1 + (seen.agg(F.max("_load")).first()[0] or 0)
        # the ids lie apart, so that a read knows how few they are and sends them to the files instead of the files to them; the delta makes them count
        rows.select(*self._ids).write.mode("overwrite").parquet(f"{self.path}/ids/_load={load}")
        rows.write.mode("overwrite").parquet(f"{self.path}/deltas/_load={load}")

    def _last(self, spark: SparkSession) -> DataFrame | None:
        """The last delta of each point."""
        seen = self._deltas(spark)
        if seen is None:
            return None
        rest = [c for c in self.schema.names if c not in self._ids]
        rows = seen.groupBy(*self._ids).agg(F.max_by(F.struct(*rest, "_gone"), "_load").alias("_row"))
        return rows.select(*self._ids, "_row.*").select(*self.schema.names, "_gone")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All points as they are now. Filters on the keys reach the files and the deltas; files are compared with ids of the deltas alone."""
        base, last = self._base(spark), self._last(spark)
        if base is None:
            base = spark.createDataFrame([], self.schema)
        if last is None:
            return base
        load = self._deltas(spark).agg(F.coalesce(F.max("_load"), F.lit(0))).first()[0]
        gone = spark.read.parquet(f"{self.path}/ids").where(F.col("_load") <= load).select(*(F.col(c).alias(f"_{c}") for c in self._ids))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self._ids))
        return base.join(gone, same, "left_anti").unionByName(last.where("not _gone").drop("_gone"))

    def compact(self, spark: SparkSession) -> int:
        """Merge the deltas into the files of the collections that they touch, and of no others; returns the number of those collections."""
        last = self._last(spark)
        if last is None:
            return 0
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys))
        with scratch(spark):
            touched = saved(last.select(*(F.col(k).alias(f"_{k}") for k in self.keys)).distinct())
            near = self._near(touched)
            merged = saved(self.rows(spark).where(near).join(touched, same, "left_semi"))
            base = self._base(spark)
            if base is not None:  # collections that lost their last point have no row that would replace their files
                empty = touched.join(merged.select(*self.keys).distinct(), same, "left_anti")
                for row in base.where(near).select(*self.keys, "_metadata.file_path").join(empty, same, "left_semi").select("file_path").distinct().toLocalIterator():
                    file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row[0]))
                    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
            self.replace(merged)
            n = touched.count()
        deleted(spark, f"{self.path}/deltas")
        deleted(spark, f"{self.path}/ids")
        return n


    def _near(self, touched: DataFrame) -> Column:
        """True in the touched collections, and in few others: a filter on partition columns, so that other folders are not read. Where
        over MOST_NAMED collections are touched it is true everywhere, and the join alone tells."""
        named = touched.limit(MOST_NAMED + 1).collect()
        if len(named) > MOST_NAMED:
            return F.lit(True)
        out = F.lit(True)
        for k in self.keys:
            values = {r[f"_{k}"] for r in named}
            own = F.col(k).isin(*sorted(v for v in values if v is not None))
            out = out & (own | F.col(k).isNull() if None in values else own)
        return out


def counted(points: DataFrame, keys: list[str], section: str = "section_id") -> DataFrame:
    """(keys, points, sections, tables, texts, filled) of each collection: its points, distinct sections, points by type, and those whose text is not blank."""
    kind = lambda t: F.count_if(F.col("chunk_type") == t)
    # two steps, so that the distinct sections of a large collection are not gathered with its rows
    some = points.groupBy(*keys, section).agg(F.count(F.lit(1)).alias("points"), kind("table").alias("tables"), kind("text").alias("texts"), F.count_if(F.trim("text") != "").alias("filled"))
    return some.groupBy(*keys).agg(F.sum("points").alias("points"), F.count(section).alias("sections"), *(F.sum(c).alias(c) for c in ("tables", "texts", "filled")))


def sizes(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """(folder, files, bytes) of the files beneath path, by the first `depth` folders of their place there (0: one row in all, `.`), from
    the listing alone: no file is opened. Hidden files and those that begin with _ are not counted; nothing there is no row."""
    listed = stored_files(spark, path)
    if listed is None:
        return spark.createDataFrame([], "folder string, files long, bytes long")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    parts = F.split(F.substr(F.col("path"), F.lit(len(full) + 2)), "/")
    folders = F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))
    rows = listed.select(F.when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise(".").alias("folder"), "length")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def stored_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length) of all files beneath path; None where it is missing."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
