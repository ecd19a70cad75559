"""Shards of near equal sizes by sampled splitters, without user functions."""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.common import saved

#: A record of more than this part of a shard is dealt by itself; there are at most shards * HEAVY of them.
HEAVY = 64
RANGES = 2048
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 8
#: Samples for each range's share of bytes at which overfull ranges are subdivided no further; they only take their task longer.
DENSEST = 4096


def _array(values: list[int]) -> Column:
    """A constant array of longs; folded by the optimizer, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _place(first: Column, second: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts are at or below (first, second), by binary search."""
    if not cuts:
        return F.lit(0)
    a, b = _array([x for x, _ in cuts]), _array([y for _, y in cuts])
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))

    def step(at: Column, width: Column) -> Column:
        i = at + width
        x, y = F.get(a, i - 1), F.get(b, i - 1)
        return F.when((i <= len(cuts)) & ((x < first) | ((x == first) & (y <= second))), i).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _cuts(rows: DataFrame, rate: float, width: float) -> list[tuple[int, int]]:
    """Keys at the quantiles of a size-weighted sample: about `width` bytes lie between two.

    A record is drawn with probability size * rate and stands for 1 / rate bytes, or for its own if drawn surely.
    The sample has about sum(size) * rate records whatever the number of rows.
    """
    chance = F.col("size") * rate
    drawn = F.pmod(F.xxhash64("h", "k", F.lit(11)), F.lit(1 << 40)) / float(1 << 40) < chance
    weight = F.sum(F.greatest(F.col("size"), F.lit(1 / rate)))  # rows of one key are drawn together and come as one
    found = sorted((r["h"], r["k"], r["w"]) for r in rows.where(drawn).groupBy("h", "k").agg(weight.alias("w")).collect())
    out, so_far = [], 0.0
    for h, k, w in found:
        if math.floor((so_far + w) / width) > math.floor(so_far / width):
            out.append((h, k))
        so_far += w
    return out


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of `shards` shards of near equal bytes.

    The key is the hash of the text and then of the id, so that equal texts lie together, and a hot text is cut
    between its copies. Size-weighted samples of the keys give the splitters of many narrow ranges; ranges that turn
    out to hold over twice their share are sampled more and more densely and subdivided. Each range then sorts its own
    rows, and the sums of the ranges before it tell where they fall among the shards' capacities. Records that are
    large beside a shard (bounded in number by the total size) go first, each to the smallest shard so far, so that
    shards differ by less than about 1/64 of their size. slot numbers the rows of a shard without a gap.
    A null text has size 16 and the checksum of no bytes; a null id is a key like any other; repeated rows are all
    placed; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = saved(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col), F.lit(5)).alias("k"),
    ))
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    large = F.col("size") * (shards * HEAVY) > total
    order = ["h", "k", "doc_id", "text_crc32", "size"]
    heavy = keys.where(large).withColumn("i", F.row_number().over(W.orderBy(*order)))
    sizes = [r["size"] for r in heavy.orderBy("i").select("size").collect()]
    heap = [(0, s) for s in range(shards)]
    shard_of, slot_of, filled, taken = [0] * len(sizes), [0] * len(sizes), [0] * shards, [0] * shards
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        _, s = heapq.heappop(heap)
        shard_of[i], slot_of[i] = s, taken[s]
        filled[s] += sizes[i]
        taken[s] += 1
        heapq.heappush(heap, (filled[s], s))
    first = heavy.select("doc_id", "size", "text_crc32", F.get(_array(shard_of), F.col("i") - 1).cast("int").alias("shard"), F.get(_array(slot_of), F.col("i") - 1).alias("slot"))
    light, room = keys.where(~large), total - sum(sizes)
    if len(sizes) == n:
        return first
    level = _level(filled, room)
    ends = list(accumulate(max(0.0, level - f) for f in filled))[:-1]

    ranges = max(ranges, math.ceil(n / ROWS_PER_RANGE))
    width = room / ranges
    cuts = _cuts(light, SAMPLES_PER_RANGE / width, width)
    density = SAMPLES_PER_RANGE
    while True:
        placed = light.withColumn("r", _place(F.col("h"), F.col("k"), cuts))
        found = {r["r"]: (r["b"], r["n"], r["keys"]) for r in placed.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), (F.min(F.struct("h", "k")) != F.max(F.struct("h", "k"))).alias("keys")).collect()}
        full = [r for r, (b, _, several) in found.items() if b > 2 * width and several]
        if not full or density >= DENSEST:
            break
        density *= 8
        crowded = placed.where(F.array_contains(_array(sorted(full)), F.col("r").cast("bigint")))
        cuts = sorted({*cuts, *_cuts(crowded, density / width, width)})
    per = [found.get(r, (0, 0))[:2] for r in range(len(cuts) + 1)]
    bytes_before, rows_before = ([0, *accumulate(x[k] for x in per)] for k in (0, 1))
    own = W.partitionBy("r").orderBy(*order)
    middle = F.get(_array(bytes_before), "r") + F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    shard = F.size(F.filter(_array([math.floor(e) for e in ends]), lambda e: e < F.col("middle")))
    lined = placed.withColumn("middle", middle).withColumn("at", F.get(_array(rows_before), "r") + F.row_number().over(own) - 1)
    lined = saved(lined.select("doc_id", "size", "text_crc32", shard.alias("shard"), "at"))
    many = {r["shard"]: r["n"] for r in lined.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0, *accumulate(many.get(s, 0) for s in range(shards))]
    slot = F.col("at") - F.get(_array(starts), "shard") + F.get(_array(taken), "shard")
    return first.unionByName(lined.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot")))


def _level(filled: list[int], room: int) -> float:
    """The height to which all shards can be filled when so many bytes are poured on what they hold."""
    own = sorted(filled)
    for k in range(1, len(own) + 1):
        level = (sum(own[:k]) + room) / k
        if k == len(own) or level <= own[k]:
            return level
    return 0.0


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs in folders shard=0 ... under path, and return their placement. Ids must be unique and not null."""
    placed = saved(sharded(docs, shards, id_col, text_col))
    if not placed.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        raise ValueError(f"{id_col} repeats or is null: rows can't be told apart")
    own = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.join(own, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
