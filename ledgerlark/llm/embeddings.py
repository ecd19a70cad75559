"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import integer_id, per_key, saved, scratch
from ledgerlark.llm.components import connected_components
from ledgerlark.llm.simhash import lowest_labels


def plan(rows: int, threshold: float, missed: float, bucket: int = 64) -> tuple[int, int]:
    """Bits of a signature and number of tables: buckets of about `bucket` evenly spread rows, and a pair at the
    threshold missed by all tables with probability `missed`. A hyperplane parts two vectors with angle / pi."""
    bits = min(32, max(6, math.ceil(math.log2(max(rows, 2) / bucket))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - same))


@lru_cache(4)
def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Normals of the hyperplanes in whole numbers."""
    return np.rint(np.random.default_rng(97).standard_normal((dim, bits * tables)) * 2**10)


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One signature for each unit vector and table. Products of whole numbers this small are exact in whatever order they are
    summed, so that every task that meets a vector finds the same signs."""
    dim = x.shape[1]
    signs = np.rint(x * 2**24) @ planes(dim, bits, tables) > 0
    return (signs.reshape(len(x), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def signed(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """reps (id, label, dim, copies, vec) with signs, one signature for each table."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(dims).tolist():
                own = np.nonzero(dims == dim)[0]
                x = unit(batch.column("vec").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), dim)
                out[own] = signatures(x, bits, tables)
            signs = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], [*batch.schema.names, "signs"])

    kind = reps.schema["vec"].dataType.simpleString()
    return reps.mapInArrow(work, f"id long, label string, dim int, copies long, vec {kind}, signs array<long>")


def _cells(table: pa.Table, keys: list[str], threshold: float, bits: int, tables: int, small: int = 48) -> pa.Table:
    """Links within each cell that no earlier table has: for each row how many vectors, and the lowest row reached."""
    n = table.num_rows
    dims, turn = table.column("dim").to_numpy(), table.column("t").to_numpy()
    ids, copies, own = (table.column(k).to_numpy() for k in ("id", "copies", "own"))
    x_part, y_part = table.column("x").to_numpy(), table.column("y").to_numpy()
    signs = np.zeros((n, tables), np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        values = table.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    begin = np.nonzero(new)[0]
    end = np.append(begin[1:], n)
    links, pairs = np.zeros(n, np.int64), []
    before = np.arange(tables)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = (x_part[i] == y_part[i]) | (own[i] != own[j])  # pairs within a part are the business of its own cell
        i, j = i[ok], j[ok]
        seen = ((signs[i] == signs[j]) & (before[None, :] < turn[i][:, None])).any(axis=1)
        i, j = i[~seen], j[~seen]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        pairs.append((i, j))

    vectors = table.column("vec").combine_chunks()
    for dim in np.unique(dims).tolist():
        rows = np.nonzero(dims == dim)[0]
        unit_rows = unit(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dim)
        for k in range(0, len(rows), 8192):
            signs[rows[k : k + 8192]] = signatures(unit_rows[k : k + 8192], bits, tables)
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        here = dims[begin] == dim
        s, e = begin[here], end[here]
        few = e - s <= small
        until = np.zeros(n, np.int64)
        for a, b in zip(s[few].tolist(), e[few].tolist(), strict=True):
            until[a:b] = b
        at, step = np.nonzero(until > np.arange(n) + 1)[0], 1
        while len(at):
            for k in range(0, len(at), 65_536):
                i = at[k : k + 65_536]
                cosine = np.einsum("ij,ij->i", unit_rows[place[i]], unit_rows[place[i + step]])
                i = i[cosine >= threshold]
                take(i, i + step)
            step += 1
            at = at[until[at] > at + step]
        for a, b in zip(s[~few].tolist(), e[~few].tolist(), strict=True):
            block = unit_rows[place[a:b]]
            for k in range(0, b - a, 256):
                i, j = np.nonzero(block[k : k + 256] @ block.T >= threshold)
                up = i + k < j
                take(a + k + i[up], a + j[up])
    i, j = (np.concatenate(z) for z in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    label = lowest_labels(n, i, j)
    out = np.nonzero(links)[0]
    return pa.table({"id": pa.array(ids[out]), "n": pa.array(links[out]), "root": pa.array(ids[label[out]])})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, missed: float = 1e-5, most: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row, linked at cosine >= threshold under equal labels.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, like rows without a label
    or an id; vectors of other lengths link with nothing. Equal vectors under a label are one node with a number
    of copies, which link one another. Each link is counted in the first table that finds it. A bucket of more than `most`
    nodes is dealt into parts by a hash, and each pair of parts is one cell, so that no task holds an unbounded
    bucket and no pair is lost. Rows that repeat an id are vectors of their own with equal results. An empty table
    gives no rows; other columns are not read. The result is a table in the shared folder.
    """
    spark = vectors.sparkSession
    rows = vectors.select(integer_id(vectors, id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    with scratch(spark) as kept:
        good = rows.where(usable)
        reps = saved(good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "label", F.size("vec").alias("dim"), "copies", "vec"))
        largest = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
        bits, tables = plan(largest, threshold, missed)
        marked = saved(signed(reps, bits, tables))
        keys = ["label", "dim", "t", "v"]
        placed = marked.select("label", "dim", "id", "copies", "vec", F.posexplode("signs").alias("t", "v"))
        hot = saved(marked.select("label", "dim", F.posexplode("signs").alias("t", "v")).groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts")))
        if hot.isEmpty():
            cells = placed.withColumns({c: F.lit(0) for c in ("own", "x", "y")})
        else:
            cells = placed.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            cells = cells.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cells = cells.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        whole = [*keys, "x", "y"]
        cells = cells.select(*whole, "own", "id", "copies", "vec")
        dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *whole).sortWithinPartitions(*whole)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return per_key(batches, whole, lambda table: _cells(table, whole, threshold, bits, tables))

        found = saved(dealt.mapInArrow(work, "id long, n long, root long"))
        classes = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        direct = found.groupBy("id").agg(F.sum("n").alias("n"))
        nodes = reps.join(direct, "id", "left").join(classes, F.col("id") == F.col("node"), "left")
        nodes = nodes.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        linked = good.join(nodes, ["label", "vec"]).select("id", "n_links", "component_id")
        alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = linked.unionByName(alone)
        return kept(out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")))
