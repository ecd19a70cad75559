"""A Merkle manifest of a dataset: exact ranks from histograms of id digits, a trie keyed by rank digits, proofs and their folds.

No row is sorted against all others. Ids are counted by their leading digits, level beneath level; prefix sums of siblings, from the
top down, tell how many ids of a group come before each bucket, and only the rows of a bucket are sorted. The digits of a rank
in base 16 are a node's key in its group's trie: nodes with an equal prefix are one run, and the longest prefixes are reduced first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.common import integer_id, saved, scratch

FANOUT = 16
#: Rank digits that one shuffle reduces: a row holds the 256 nodes of one prefix.
DIGITS = 2
SHIFT = 4 * DIGITS
#: Bits of an id that a histogram level counts by, and rows of a bucket that are sorted as they are.
BITS, MOST = 10, 8192
GROUP = ["nil", "grp"]
RUNNING = (W.unboundedPreceding, -1)


def _field(value: Column) -> Column:
    body = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values, each written with its length; a null differs from every text."""
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def _before(column: str, per: list, order: list) -> Column:
    return F.coalesce(F.sum(column).over(W.partitionBy(*per).orderBy(*order).rowsBetween(*RUNNING)), F.lit(0))


def _starts(entries: DataFrame) -> DataFrame:
    """(group, bucket, n, start, total): the ids of a bucket share all but their last BITS bits; start is the number of rows of the group before it.

    Counts roll up from the finest level; a window never sees more siblings than one digit has values. Null ids are bucket -1."""
    low, high = entries.agg(F.min("id"), F.max("id")).first()
    bits = 0 if low is None else ((low ^ high) & ((1 << 64) - 1)).bit_length()
    finest = saved(entries.groupBy(*GROUP, "bucket").agg(F.count(F.lit(1)).alias("n")))
    levels = [finest]
    for _ in range(BITS, bits, BITS):
        levels.append(levels[-1].groupBy(*GROUP, F.shiftright("bucket", BITS).alias("bucket")).agg(F.sum("n").alias("n")))
    top = levels.pop()
    found = top.withColumn("start", _before("n", GROUP, ["bucket"])).withColumn("total", F.sum("n").over(W.partitionBy(*GROUP)))
    for level in reversed(levels):
        own = level.withColumn("up", F.shiftright("bucket", BITS))
        own = own.withColumn("inner", _before("n", [*GROUP, "up"], ["bucket"]))
        above = found.select(*GROUP, F.col("bucket").alias("up"), "start", "total")
        found = own.join(above, [*GROUP, "up"]).select(*GROUP, "bucket", "n", (F.col("start") + F.col("inner")).alias("start"), "total")
    return found


def _refined(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Ranks of the rows of overfull buckets, which repeat ids: equal rows become one with a number of copies, and the rest is counted on by the
    last digit of the id and by digits of the leaf until no bucket is overfull."""
    opened = rows.groupBy(*columns, *GROUP, F.array("bucket").alias("path"), "start", "total").agg(F.count(F.lit(1)).alias("copies"))
    done = []
    for k in range(1 + 64 // 3):
        digit = F.coalesce(F.col("id").bitwiseAND((1 << BITS) - 1), F.lit(0)) if k == 0 else F.conv(F.substring("digest", 3 * k - 2, 3), 16, 10).cast("long")
        own = saved(opened.withColumn("digit", digit))
        counts = own.groupBy(*GROUP, "path", "digit").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("several"))
        counts = counts.withColumn("inner", _before("n", [*GROUP, "path"], ["digit"])).drop("n")
        met = own.join(counts, [*GROUP, "path", "digit"]).withColumn("start", F.col("start") + F.col("inner")).withColumn("path", F.concat("path", F.array("digit")))
        done.append(met.where(F.col("several") <= most).drop("several", "inner", "digit"))
        opened = saved(met.where(F.col("several") > most).drop("several", "inner", "digit"))
        if opened.isEmpty():
            break
    else:
        done.append(opened)
    found = reduce(DataFrame.unionByName, done)
    found = found.withColumn("start", F.col("start") + _before("copies", [*GROUP, "path"], ["id", "digest"]))
    last = F.col("copies") - 1
    spread = found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(last, 16)))).repartition(*GROUP, "path", "digest", "block")  # copies of one row go to many tasks
    begin = F.shiftleft("block", 16)
    spread = spread.withColumn("copy", F.explode(F.sequence(begin, F.least(last, begin + 65_535))))
    return spread.select(*columns, *GROUP, (F.col("start") + F.col("copy")).alias("rank"), "total")


def ranked(entries: DataFrame, most: int = MOST) -> DataFrame:
    """entries (id, nil, grp, digest and others) with rank, counted from 0 in the order of id and digest, null ids first, and its group's total."""
    columns = [c for c in entries.columns if c not in GROUP]
    unsigned = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))
    rows = entries.withColumn("bucket", F.coalesce(F.shiftrightunsigned(unsigned, BITS), F.lit(-1).cast("long")))
    starts = saved(_starts(rows.select("id", *GROUP, "bucket")))
    met = rows.join(starts.where(F.col("n") <= most).drop("n"), [*GROUP, "bucket"])
    place = F.row_number().over(W.partitionBy(*GROUP, "bucket").orderBy("id", "digest"))
    found = met.select(*columns, *GROUP, (F.col("start") + place - 1).alias("rank"), "total")
    hot = starts.where(F.col("n") > most).drop("n")
    return found if hot.isEmpty() else found.unionByName(_refined(rows.join(hot, [*GROUP, "bucket"]), columns, most))


def _sequenced(groups: DataFrame, order: list[Column]) -> DataFrame:
    """groups with rank and total in an order of any columns: ranges of rows, whose sizes are summed."""
    dealt = saved(groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", _before("n", [], ["part"]).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))  # a row for each range
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(sizes, "part").withColumn("rank", F.col("start") + F.col("place") - 1).drop("part", "place", "start")


def _once(digests: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * FANOUT + 1, F.lit(FANOUT)), "").cast("binary"), 256))


def _reduced(nodes: DataFrame, keys: list[str], step: int, carried: list[str]) -> DataFrame:
    """A row (keys, at, total, own, digests, ones, members, digest) for each prefix of all but the last DIGITS digits: its nodes in order, the digests
    one level above them, and the one above that. own is how many levels a trie of that total still has here: of 0 to DIGITS."""
    member = F.struct(F.col("rank").bitwiseAND((1 << SHIFT) - 1).alias("pos"), "digest", *carried)
    rows = nodes.groupBy(*keys, F.shiftright("rank", SHIFT).alias("at")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))
    depth = reduce(lambda x, y: x + y, ((F.col("total") > FANOUT**d).cast("int") for d in range(15)))
    rows = rows.withColumn("own", F.greatest(F.lit(0), F.least(F.lit(DIGITS), depth - DIGITS * step))).withColumn("depth", depth)
    rows = rows.withColumn("digests", F.transform("members", lambda m: m["digest"]))
    rows = rows.withColumn("ones", F.when(F.col("own") > 0, _once(F.col("digests"))).otherwise(F.col("digests")))
    last = F.when(F.col("own") > 1, _once(F.col("ones"))).otherwise(F.col("ones"))
    return rows.withColumn("digest", F.get(last, F.lit(0)))


def _risen(nodes: DataFrame, keys: list[str], carried: list[str]) -> list[DataFrame]:
    """The trie from its longest prefixes up: a table for each step, the last with one row for each of keys."""
    steps = [saved(_reduced(nodes, keys, 0, carried))]
    depth = steps[0].agg(F.max("depth")).first()[0] or 0
    for step in range(1, -(-depth // DIGITS)):
        below = steps[-1].select(*keys, F.col("at").alias("rank"), "total", "digest")
        steps.append(saved(_reduced(below, keys, step, [])))
    return steps


def _others(digests: str, pos: Column) -> Column:
    """What stands left and right of a node in its run, as text."""
    first = F.floor(pos / FANOUT).cast("int") * FANOUT
    left = F.slice(F.col(digests), first + 1, pos - first)
    right = F.slice(F.col(digests), pos + 2, FANOUT - 1 - (pos - first))
    return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))


def _descended(steps: list[DataFrame], keys: list[str], above: DataFrame, told: list[str], carried: list[str]) -> DataFrame:
    """(keys, digest, carried, told, path) of each node of the first step. above has the path beyond the top of each of keys, and the columns told."""
    down = steps[-1].join(above, keys)
    for k in range(len(steps) - 1, -1, -1):
        def own(m: Column) -> Column:
            pos = m["pos"].cast("int")
            return F.slice(F.array(_others("digests", pos), _others("ones", F.floor(pos / FANOUT).cast("int"))), F.lit(1), F.col("own"))

        rows = down.select(*keys, "at", *told, "above", F.explode(F.transform("members", lambda m: F.struct(m.alias("m"), own(m).alias("path")))).alias("x"))
        rows = rows.select(*keys, "at", *told, F.col("x.m").alias("m"), F.concat("x.path", "above").alias("path"))
        if k:
            rank = F.shiftleft("at", SHIFT) + F.col("m.pos")
            down = steps[k - 1].join(rows.select(*keys, rank.alias("at"), *told, F.col("path").alias("above")), [*keys, "at"])
    return rows.select(*keys, "m.digest", *(f"m.{c}" for c in carried), *told, "path")


def manifest(docs: DataFrame, fields: list[str], then: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, most: int = MOST) -> DataFrame:
    """What `then` makes of (id, group, leaf, changed_leaf, subroot, root, path) of each row, as a table: a Merkle tree of 16 children a
    node over each group's rows in the order of ids, and one over the groups in their order, null first, then bytewise.

    leaf is the digest of the fields. changed_leaf is that of the fields with other values for those in `changed`, else null. path has, from the leaf's
    own run to the root's, the digests left and right of the way up: about a kilobyte for each level, which is why `then` comes before anything is written. A lone node is its own root; a last run may hold one node, which is
    hashed once more. Null ids come first; rows that repeat an id follow one another by their leaves, equal rows at any place
    among one another; null fields and groups are values of their own; long texts are hashed in their row and go no further.
    An empty table gives no rows. Columns that are not named are not read, whatever their names.
    """
    name = lambda c: F.col(f"`{c}`")
    of = lambda c: (changed or {}).get(c, name(c))
    other = F.when(reduce(lambda x, y: x | y, (~of(c).eqNullSafe(name(c)) for c in changed)), leaf(*map(of, fields))) if changed else F.lit(None).cast("string")
    group = name(group_col).cast("string")
    with scratch(docs.sparkSession) as kept:
        entries = docs.select(integer_id(docs, id_col).alias("id"), group.isNull().alias("nil"), F.coalesce(group, F.lit("")).alias("grp"), leaf(*map(name, fields)).alias("digest"), other.alias("other"))
        carried = ["id", "other"]
        steps = _risen(ranked(entries, most), GROUP, carried)
        tops = steps[-1].select(*GROUP, "digest")
        upper = _risen(_sequenced(tops, [F.desc("nil"), F.asc("grp")]).withColumn("one", F.lit(0)), ["one"], GROUP)
        root = upper[-1].select("one", F.col("digest").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("above"))
        groups = _descended(upper, ["one"], root, ["root"], GROUP).select(*GROUP, F.col("digest").alias("subroot"), "root", F.col("path").alias("above"))
        rows = _descended(steps, GROUP, groups, ["subroot", "root"], carried)
        group = F.when(~F.col("nil"), F.col("grp")).alias("group")
        found = rows.select("id", group, F.col("digest").alias("leaf"), F.col("other").alias("changed_leaf"), "subroot", "root", "path")
        return kept(then(found))


def proof(path: Column) -> Column:
    """All siblings on the way up, level by level, left to right, as text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, digest, lambda own, p: F.sha2(F.concat(p["l"], own, p["r"]).cast("binary"), 256))
