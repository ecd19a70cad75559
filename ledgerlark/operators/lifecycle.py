"""Life of an index: upserts, incremental skips, eviction, failure caches, copies and priority loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sections that are indexed first, and limits.
PRIORITY_SECTIONS = ("risk factors", "md&a", "management's discussion", "business", "income", "balance sheet", "cash flow", "equity", "financial statements")
LEAST_TO_SPLIT, STALE_DAYS, FAILURE_SECONDS = 40, 30, 300


def upserted(old: DataFrame, new: DataFrame, keys: list[str], load_order: str | None = None) -> DataFrame:
    """old without the keys of new, and new; of rows of new with equal keys the last loaded."""
    if load_order:
        new = new.withColumn("_last", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(load_order)))).where("_last = 1").drop("_last")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key in a log that is only appended to."""
    rows = log.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in log.columns if c not in keys)), at).alias("_row"))
    return rows.select(*keys, "_row.*").select(*log.columns)


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What no output exists for yet."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def is_priority(section: str = "section_name") -> Column:
    low = F.lower(F.coalesce(F.col(section), F.lit("")))
    return reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in PRIORITY_SECTIONS))


def prioritised(chunks: DataFrame, per: list[str], section: str = "section_name", least: int = LEAST_TO_SPLIT) -> DataFrame:
    """chunks with load 1 (index at once) or 2 (afterwards); a collection of few chunks, or without any that come first,
    is loaded at once. The two counts of a collection come back by a join, so that no window gathers it."""
    first = is_priority(section)
    counts = chunks.groupBy(*per).agg(F.count(F.lit(1)).alias("_n"), F.count_if(first).alias("_first"))
    rows = chunks.join(counts, per)
    return rows.withColumn("load", F.when((F.col("_n") < least) | (F.col("_first") == 0) | first, 1).otherwise(2)).drop("_n", "_first")


def stale(indexed: DataFrame, access: DataFrame, bundled: DataFrame, now: Column, days: int = STALE_DAYS, key: str = "ticker") -> DataFrame:
    """(key, last_access, collections, points) of companies that may go: not bundled, and last read over `days` ago. A company whose time of reading is
    missing or unreadable stays."""
    at = access.select(key, F.expr("try_cast(last_access as timestamp)").alias("last_access")).where("last_access is not null").groupBy(key).agg(F.max("last_access").alias("last_access"))
    old = at.where(F.col("last_access") < now - F.make_dt_interval(F.lit(days))).join(bundled.select(key), key, "left_anti")
    found = indexed.groupBy(key).agg(F.count_distinct("collection").alias("collections"), F.sum("points").alias("points"))
    return old.join(found, key, "left").select(key, "last_access", F.coalesce("collections", F.lit(0)).alias("collections"), F.coalesce("points", F.lit(0)).alias("points"))


def not_cached(requests: DataFrame, failures: DataFrame, keys: list[str], seconds: int = FAILURE_SECONDS) -> DataFrame:
    """Requests (keys, ts) that no failure (keys, ts) of the last `seconds` before, or at the same time, forbids.

    The last failure before a request is a running maximum over both, so that a request never meets all failures of its key. Null keys
    and times were never cached."""
    free = [c for c in requests.columns if c not in {*keys, "ts"}]
    no_row = F.lit(None).cast(requests.select(F.struct(*free) if free else F.struct(F.lit(0))).schema[0].dataType)
    asked = requests.select(*keys, "ts", F.lit(1).alias("_kind"), (F.struct(*free) if free else F.struct(F.lit(0))).alias("_row"))
    failed = failures.where("ts is not null").dropDuplicates([*keys, "ts"]).select(*keys, "ts", F.lit(0).alias("_kind"), no_row.alias("_row"))
    last = F.max(F.when(F.col("_kind") == 0, F.col("ts"))).over(W.partitionBy(*keys).orderBy("ts", "_kind").rowsBetween(W.unboundedPreceding, 0))
    rows = asked.unionByName(failed).withColumn("_last", last).where("_kind = 1")
    unknown = reduce(lambda x, y: x | y, (F.col(k).isNull() for k in keys))
    recent = F.coalesce(F.col("_last") > F.col("ts") - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False)) & ~unknown
    return rows.where(~recent).select(*[F.col(c) if c in {*keys, "ts"} else F.col(f"_row.{c}").alias(c) for c in requests.columns])


def copy_plan(local: DataFrame, remote: DataFrame, key: str = "collection") -> DataFrame:
    """(key, local_points, remote_points, action): skip where counts are equal, else copy, resume or (only there) extra."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((local, "local_points"), (remote, "remote_points")))
    rows = a.join(b, key, "full_outer").na.fill(0, ["local_points", "remote_points"])
    action = F.when(F.col("local_points") == F.col("remote_points"), "skip").when(F.col("local_points") == 0, "extra").when(F.col("remote_points") == 0, "copy").otherwise("resume")
    return rows.withColumn("action", action)


def to_copy(local: DataFrame, remote: DataFrame, key: str = "collection", ident: str = "id") -> DataFrame:
    """The points that a copy or its resumption still has to write."""
    plan = copy_plan(local, remote, key).where(F.col("action").isin("copy", "resume")).select(key)
    return local.join(plan, key, "left_semi").join(remote.select(key, ident), [key, ident], "left_anti")


def store_partitions(rows: DataFrame, path: str, keys: list[str], order: list[str] | None = None, lookup: list[str] | None = None) -> None:
    """Replace the partitions that rows have, and no others. rows must not be read from path.

    With `order`, ranges of keys and order make the files and rows lie in that order, so that a large collection is written by many
    tasks and a filter on these columns skips row groups by their least and greatest values. Columns of `lookup` get Bloom filters, for
    equality with values that lie everywhere."""
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order) if order else rows.repartition(*keys)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    for c in lookup or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
