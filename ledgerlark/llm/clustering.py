"""Centroid clustering of whole-number vectors with Hamerly's bounds: exact sums, exact distances, no distance where the bounds decide.

Each vector keeps, from round to round, an upper bound of the distance to its own centroid and one lower bound of that to
every other. A round loosens both by how far the centroids went; where the upper one is still below, the vector stays without
a distance. Else its own distance is taken, and only where that doesn't decide either, all of them, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import dropped, integer_id, saved, scratch

#: Components of this size or more are left out: squared distances and sums of the others fit 64 bits.
LARGEST = 1 << 16
#: What bounds give way for rounding, as a share of the numbers they are made of: thousands of times a double's own error.
SLACK = 1e-12

STATE = "id long, q array<int>, was int, own int, upper double, lower double, scanned boolean"


def distances(q: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    return np.stack([((q - c) ** 2).sum(axis=1) for c in centers], axis=1)


def bounded(q: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number), the bounds, and which vectors were compared with all centroids.

    own is -1 before the first round. drift is how far each centroid went since."""
    k = len(centers)
    own, known = own.copy(), own >= 0
    order = np.argsort(drift)
    most, next_most = drift[order[-1]], drift[order[-2]] if k > 1 else 0.0
    upper = np.where(known, (upper + drift[own]) * (1 + SLACK), np.inf)
    lower = lower * (1 - SLACK) - np.where(own == order[-1], next_most, most) * (1 + SLACK)
    gaps = np.sqrt(distances(centers, centers).astype(float)) + np.where(np.eye(k, dtype=bool), np.inf, 0)
    enough = np.maximum(lower, gaps.min(axis=1)[own] / 2 * (1 - SLACK))  # nearer than half way to the next centroid
    open_ = np.nonzero(~(known & (upper < enough)))[0]
    some = open_[known[open_]]
    upper[some] = np.sqrt(((q[some] - centers[own[some]]) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
    open_ = open_[~(known[open_] & (upper[open_] < enough[open_]))]
    found = distances(q[open_], centers)
    own[open_] = found.argmin(axis=1)
    two = np.sort(found, axis=1)[:, :2].astype(float)
    upper[open_] = np.sqrt(two[:, 0]) * (1 + SLACK)
    lower[open_] = np.sqrt(two[:, 1]) * (1 - SLACK) if k > 1 else np.inf
    scanned = np.zeros(len(q), bool)
    scanned[open_] = True
    return own, upper, lower, scanned


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(state: DataFrame, centers: np.ndarray, drift: np.ndarray) -> DataFrame:
    dim, names = centers.shape[1], state.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was = batch.column("own").to_numpy()
            own, upper, lower, scanned = bounded(_matrix(batch, dim), was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), centers, drift)
            columns = [batch.column("id"), batch.column("q"), was, own.astype(np.int32), upper, lower, scanned]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return state.mapInArrow(work, STATE)


def _changes(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid, how many more vectors it has than before and by how much the sums of their components grew: sums of each batch,
    made of those vectors alone that went from one to another, are added up to a row for each centroid and component."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, own, was = _matrix(batch, dim), batch.column("own").to_numpy(), batch.column("was").to_numpy()
            for c in np.unique([own, was]).tolist():
                if c >= 0:
                    by = q[own == c].sum(axis=0) - q[was == c].sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([int((own == c).sum() - (was == c).sum())]), pa.array([by.tolist()])], ["c", "n", "by"])

    parts = state.where("own <> was").select("q", "was", "own").mapInArrow(work, "c int, n long, by array<long>")
    rows = parts.select("c", "n", F.posexplode("by").alias("i", "by")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("by").alias("by")).collect()
    found = {r["c"]: (r["n"], [0] * dim) for r in rows}
    for r in rows:
        found[r["c"]][1][r["i"]] = r["by"]
    return found


def clustered(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", trace: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `dim` components, none null or non-finite.

    A component x becomes floor(scale * x). Centroids begin as the vectors whose ids have the least SHA-256 after the seed (of
    repeated ids, in the order of their components; fewer vectors, fewer centroids), and a round gives each the floors of the
    means of its vectors; one without vectors stays where it is. Vectors of other lengths, nulls and components of 65,536 or
    more, whose distances need not fit 64 bits, have no row. Rows without an id are clustered but begin nothing; rows that
    repeat an id are vectors of their own; an empty table gives no rows; other columns are not read. Each round writes the
    vectors with their bounds once, without a shuffle, and sums only those that moved; it ends early where no centroid moves.
    trace gets, for each pass, how many vectors there are and how many were compared with all centroids.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(f"`{vec_col}`"), lambda v: v.cast("double"))
    usable = F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)), F.lit(False))
    whole = vectors.where(usable).select(integer_id(vectors, id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("q"))
    with scratch(spark) as kept:
        state = saved(whole.select("id", "q", *(F.lit(v).cast(t).alias(c) for c, t, v in (("was", "int", -1), ("own", "int", -1), ("upper", "double", 0), ("lower", "double", 0), ("scanned", "boolean", False)))))
        first = state.where("id is not null").select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h")).orderBy("h", "q").limit(clusters).collect()
        centers = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
        drift = np.zeros(len(centers))
        many, sums = [0] * len(centers), [[0] * dim for _ in centers]
        out = "id long, cluster int, distance long"
        if not len(centers):
            return kept(spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("id", id_col))
        for turn in range(rounds + 1):
            now = saved(_assigned(state, centers, drift))
            dropped(state)
            state = now
            if trace is not None:
                trace.append(tuple(state.agg(F.count(F.lit(1)), F.count_if("scanned")).first()))
            if turn == rounds:
                break
            for c, (n, by) in _changes(state, dim).items():
                many[c] += n
                sums[c] = [s + b for s, b in zip(sums[c], by, strict=True)]
            moved = np.array([[s // n for s in own] if n else old for n, own, old in zip(many, sums, centers.tolist(), strict=True)], np.int64)
            drift = np.sqrt(((moved - centers) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
            centers = moved
            if not drift.any():  # every further round would find the same
                break

        def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("own").to_numpy()
                far = ((_matrix(batch, dim) - centers[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(far)], ["id", "cluster", "distance"])

        found = saved(state.select("id", "q", "own").mapInArrow(measured, out))
        inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
        of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))
        return kept(found.select(
            F.col("id").alias(id_col), "cluster", "distance", of([inertia.get(c, 0) for c in range(len(centers))], "long").alias("cluster_inertia"),
            F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
        ))
