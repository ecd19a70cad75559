"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint is a run of 64-bit words. The top nodes of the index are masked bit patterns: fingerprints that agree
on the bits of a mask share a node. Below it, fingerprints lie in the order of their Gray rank, in which neighbours
differ in few bits, and are cut into inner nodes of 256 and leaves of 16. Each node keeps the bits that all
its members share; a leaf only counts what its inner node has not counted. Two nodes whose accumulated differences
pass the radius are pruned with all their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.common import free_name, integer_id, per_key, saved, scratch, text_batches
from ledgerlark.llm.components import connected_components

SEED = 42
LEAF, INNER = 16, 16
#: The constants of the splitmix64 generator.
GOLDEN, MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of so many words of the lower-cased (A-Z) text, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """A bit is 1 if set in over half the hashes; words after the first count bits of the hashes mixed anew."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words if len(hashes) else 0):
        h = hashes
        if k:
            h = h + np.uint64(k * GOLDEN % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * MIX[0]
            h = (h ^ (h >> np.uint64(27))) * MIX[1]
            h ^= h >> np.uint64(31)
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            bits = np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count += bits.sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * count > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, n_words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, w0, w1 ...): the fingerprint's 64-bit words of each row's whole text, as signed longs; of its distinct shingles if so asked.

    A null, empty or blank text has no words and fingerprint zero. A null id stays null. Repeated rows stay.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            hashes = (shingle_hashes(t, shingle) for t in texts)
            found = np.array([fingerprint(np.unique(h) if distinct else h, n_words) for h in hashes], np.uint64).reshape(len(texts), n_words)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[:, k].view(np.int64)) for k in range(n_words))], ["id", *names])

    names = [f"w{k}" for k in range(n_words)]
    rows = docs.select(integer_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, " + ", ".join(f"{x} long" for x in names))


def block_masks(rows: int, radius: int, group: int = 256) -> list[tuple[int, int]]:
    """Masks of one 64-bit word such that any two words within the radius agree on all bits of some mask.

    The word is cut into b blocks; at most radius of them differ, so that some b - radius agree. b is the least for
    which a node of evenly spread rows has at most `group` members: every link is found at every size.
    """
    b = radius + 1
    while b < 2 * radius and rows / 2 ** (64 // b * (b - radius)) > group:
        b += 1
    cuts = [64 * k // b for k in range(b + 1)]
    blocks = [sum(1 << i for i in range(cuts[k], cuts[k + 1])) for k in range(b)]
    return [(0, sum(c)) for c in combinations(blocks, b - radius)]


def sampled_masks(rows: int, n_words: int, differ: float, recall: float, group: int = 64) -> list[tuple[int, int]]:
    """(word, mask) pairs for radii too wide for block_masks: disjoint masks first, then shifted ones.

    Two fingerprints that differ in a share `differ` of their bits agree on a mask of k bits with probability
    (1 - differ)^k; as many masks are made as bring the chance of one agreement to `recall`.
    """
    k = min(32, max(10, math.ceil(math.log2(max(rows, 2) / group))))
    n = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** k))
    out = []
    for j in range(n):
        turn, word = divmod(j, n_words)
        step = turn % (64 // k)
        order = np.random.default_rng(1000 * word + turn // (64 // k)).permutation(64)
        out.append((word, sum(1 << int(i) for i in order[step * k : step * k + k])))
    return out


def gray_rank(words: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the Gray sequence: the running parity of its bits from the top."""
    out = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _nodes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared bits (mask) and their values (pattern) of each run of `size` fingerprints or nodes."""
    at = np.arange(0, len(words), size)
    low, high = np.bitwise_and.reduceat(words, at, axis=0), np.bitwise_or.reduceat(words, at, axis=0)
    return ~(low ^ high), low


def _distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b
    if mask is not None:
        x &= mask
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _below(i: np.ndarray, j: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of children of each pair of nodes, and the pair they come from; no pair twice."""
    grid = np.arange(fan)
    a = np.broadcast_to(i[:, None, None] * fan + grid[None, :, None], (len(i), fan, fan)).ravel()
    b = np.broadcast_to(j[:, None, None] * fan + grid[None, None, :], (len(i), fan, fan)).ravel()
    ok = np.nonzero((a < n) & (b < n) & (a <= b))[0]
    return a[ok], b[ok], ok // (fan * fan)


def near_pairs(words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one top node within the radius, by descent through inner nodes and leaves in Gray order.

    A pair's first member lies before its second in Gray order.
    """
    order = np.argsort(gray_rank(words[:, 0]), kind="stable")
    own = words[order]
    leaf_mask, leaf_low = _nodes(own, LEAF)
    inner_mask, inner_low = _nodes(own, LEAF * INNER)
    i, j = _pairs(len(inner_low))
    common = inner_mask[i] & inner_mask[j]
    so_far = _distance(inner_low[i], inner_low[j], common)
    keep = so_far <= radius
    i, j, common, so_far = i[keep], j[keep], common[keep], so_far[keep]
    for at in range(0, len(i), 64):
        a, b, of = _below(i[at : at + 64], j[at : at + 64], INNER, len(leaf_low))
        more = _distance(leaf_low[a], leaf_low[b], leaf_mask[a] & leaf_mask[b] & ~common[at : at + 64][of])
        keep = so_far[at : at + 64][of] + more <= radius
        a, b = a[keep], b[keep]
        for k in range(0, len(a), 1024):
            x, y, _ = _below(a[k : k + 1024], b[k : k + 1024], LEAF, len(own))
            near = (x < y) & (_distance(own[x], own[y]) <= radius)
            yield order[x[near]], order[y[near]]


def lowest_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For n rows with links x-y: the lowest row that each can reach."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _cell_bounds(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First rows and ends of the runs of equal keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    begin = np.nonzero(new)[0]
    return begin, np.append(begin[1:], n)


def _small_cell_pairs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius in cells of at most `small` rows, a step of distance at a time over all cells."""
    n, length = len(words), end - begin
    until = np.repeat(np.where(length <= small, end, 0), length)
    found, step = [], 1
    at = np.nonzero(until > np.arange(n) + 1)[0]
    while len(at):
        near = at[_distance(words[at], words[at + step]) <= radius]
        found.append((near, near + step))
        step += 1
        at = at[until[at] > at + step]
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _links_within(table: pa.Table, keys: list[str], names: list[str], radius: int, small: int = 48) -> pa.Table:
    """For rows sorted by top node: an edge from each row to the lowest row that it reaches within its node."""
    n = table.num_rows
    words = np.stack([table.column(x).to_numpy().view(np.uint64) for x in names], axis=1)
    ids = table.column("id").to_numpy()
    begin, end = _cell_bounds(table, keys)
    found = [_small_cell_pairs(words, begin, end, radius, small)]
    large = end - begin > small
    for s, e in zip(begin[large].tolist(), end[large].tolist(), strict=True):
        own = np.arange(e - s)
        for x, y in near_pairs(words[s:e], radius):
            fresh = own[x] != own[y]  # what hangs together already adds nothing
            if fresh.any():
                own = own[lowest_labels(e - s, own[x[fresh]], own[y[fresh]])]
        moved = np.nonzero(own != np.arange(e - s))[0]
        found.append((moved + s, own[moved] + s))
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    label = lowest_labels(n, x, y)
    moved = np.nonzero(label != np.arange(n))[0]
    return pa.table({"a": pa.array(ids[moved]), "b": pa.array(ids[label[moved]])})


ASK, MORE = 0, 1
#: Pairs within the radius that are held before they are thinned to the nearest of each two classes.
HELD_PAIRS = 200_000


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys."""
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.empty(0, np.int64)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _nearest(pairs: list[tuple[np.ndarray, ...]], most: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Of pairs (class, other class, distance, row, other row): the nearest of each two classes of which one is among the `most` nearest
    of the other; and the rows of the pairs left out."""
    p, q, d, a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
    order = np.lexsort((b, a, d, q, p))
    p, q, d, a, b = (z[order] for z in (p, q, d, a, b))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    side, far, least = np.append(p[new], q[new]), np.append(q[new], p[new]), np.tile(d[new], 2)
    order = np.lexsort((far, least, side))
    rank = np.empty(len(side), np.int64)
    rank[order] = _places(side[order])
    keep = np.zeros(len(p), bool)
    keep[np.nonzero(new)[0][np.minimum(*np.split(rank, 2)) < most]] = True
    return tuple(z[keep] for z in (p, q, d, a, b)), np.append(a[~keep], b[~keep])


def _candidates(table: pa.Table, names: list[str], masks: list[tuple[int, int]], wide: int, small: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows sorted by cell, with classes c so far: pairs of rows of one cell and two classes, of up to `wide` bits, with their distance.

    A pair is given in the first table in which it meets, and there in one cell."""
    words = np.stack([table.column(x).to_numpy().view(np.uint64) for x in names], axis=1)
    classes, turn, own = (table.column(k).to_numpy() for k in ("c", "t", "own"))
    mixed = table.column("x").to_numpy() != table.column("y").to_numpy()
    begin, end = _cell_bounds(table, CELL)

    def fresh(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(0, len(x), 65_536):
            a, b = x[k : k + 65_536], y[k : k + 65_536]
            apart = (classes[a] != classes[b]) & ~(mixed[a] & (own[a] == own[b]))  # rows of one part meet in its own cell
            a, b = a[apart], b[apart]
            met = np.zeros(len(a), bool)
            for j, (w, m) in enumerate(masks[:-1]):
                met |= (j < turn[a]) & ((words[a, w] ^ words[b, w]) & np.uint64(m) == 0)
            a, b = a[~met], b[~met]
            yield a, b, _distance(words[a], words[b])

    yield from fresh(*_small_cell_pairs(words, begin, end, wide, small))
    large = end - begin > small
    for s, e in zip(begin[large].tolist(), end[large].tolist(), strict=True):
        for x, y in near_pairs(words[s:e], wide):
            yield from fresh(x + s, y + s)


def _graded_within(table: pa.Table, names: list[str], masks: list[tuple[int, int]], wide: int, most: int) -> pa.Table:
    """Of the candidates in rows sorted by cell: ASK pairs (a, b), the nearest of each class and each of the `most` nearest other
    classes, and MORE rows (a, its part of the top node) of the pairs left out, both with their cell. Pairs are thinned as they are found."""
    ids, classes = table.column("id").to_numpy(), table.column("c").to_numpy()
    begin, end = _cell_bounds(table, CELL)
    cell = np.repeat(np.arange(len(begin)), end - begin)
    _, first, same = np.unique(np.stack([cell, classes], axis=1), axis=0, return_index=True, return_inverse=True)
    label = first[same.ravel()]  # classes by cell
    held: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 5]
    weight, bound = 0, HELD_PAIRS
    left_out = np.zeros(table.num_rows, bool)
    for x, y, d in _candidates(table, names, masks, wide):
        held.append((np.minimum(label[x], label[y]), np.maximum(label[x], label[y]), d, x, y))
        weight += len(x)
        if weight > bound:
            kept, out = _nearest(held, most)
            left_out[out] = True
            held, weight = [kept], len(kept[0])
            bound = max(HELD_PAIRS, 2 * weight)
    (_, _, _, x, y), out = _nearest(held, most)
    left_out[out] = True
    more = np.nonzero(left_out)[0]
    a = np.concatenate([np.minimum(ids[x], ids[y]), ids[more]])
    b = np.concatenate([np.maximum(ids[x], ids[y]), table.column("own").to_numpy()[more]])
    kind = np.repeat(np.array([ASK, MORE], np.int32), [len(x), len(more)])
    at = pa.array(np.concatenate([x, more]))
    return pa.table([pa.array(a), pa.array(b), pa.array(kind), *(table.column(k).take(at) for k in CELL)], schema=GRADED)


#: Standard errors by which a candidate's estimate may lie beyond the threshold.
ERRORS = 3
#: Tables that go before the others.
FIRST_TABLES = (2,)
CELL = ["t", "v", "x", "y"]
CELL_TYPES = "t int, v long, x int, y int"
GRADED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("t", pa.int32()), ("v", pa.int64()), ("x", pa.int32()), ("y", pa.int32())])
#: Top nodes, rows that pairs name or ids to leave out (16, 40 and 8 bytes each) that a join may broadcast; more are joined by a shuffle.
BROADCAST_NODES = 200_000


def _dealt(reps: DataFrame, masks: list[tuple[int, int]], most: int, first: int = 0) -> DataFrame:
    """reps by the masks from `first` on, dealt out and sorted by cell (t, v, x, y): the rows that agree on a mask. own is a row's part of its top node.

    A top node with more than `most` members is dealt into parts by a hash, and each pair of parts is one cell: no
    task holds more than two parts, and every pair of members still meets in some cell.
    """
    columns = reps.columns
    names = [x for x in reps.columns if x.startswith("w")]
    tops = F.array(*(F.struct(F.lit(k).alias("t"), F.col(names[w]).bitwiseAND(F.lit(_signed(m))).alias("v")) for k, (w, m) in enumerate(masks[first:], first)))
    rows = reps.withColumn("top", F.explode(tops)).select(*columns, "top.t", "top.v")
    hot = saved(rows.groupBy("t", "v").count().where(F.col("count") > most).select("t", "v", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    if hot.isEmpty():
        cells = rows.select(*columns, "t", "v", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("own"))
    else:
        own = F.pmod(F.xxhash64(*names, F.lit(7)), F.col("parts")).cast("int")
        few = hot.count() <= BROADCAST_NODES
        cells = rows.join(F.broadcast(hot) if few else hot, ["t", "v"], "left").select(*columns, "t", "v", F.coalesce("parts", F.lit(1)).alias("parts"))
        cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = cells.select(*columns, "t", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    return _by_cell(cells)


def _by_cell(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *CELL).sortWithinPartitions(*CELL)


def near_links(reps: DataFrame, masks: list[tuple[int, int]], radius: int, most: int = 1024) -> DataFrame:
    """Edges (a, b) between ids of distinct fingerprints (id, w0 ...) that span all links within the radius.

    Cells emit spanning edges, fewer than their members, never all pairs.
    """
    names = [x for x in reps.columns if x.startswith("w")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return per_key(batches, CELL, lambda table: _links_within(table, CELL, names, radius))

    return _dealt(reps, masks, most).mapInArrow(work, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def components(prints: DataFrame, radius: int) -> DataFrame:
    """prints with component_id, the smallest id reachable by links of at most `radius` differing bits.

    Equal fingerprints are one node, so that a group of copies costs one row. Fingerprints have one word, and the links
    are complete (block_masks). A fingerprint that only null ids have gets a null component_id. The result is a table in the shared folder.
    """
    names = [x for x in prints.columns if x.startswith("w")]
    with scratch(prints.sparkSession) as kept:
        reps = saved(prints.groupBy(*names).agg(F.min("id").alias("id")))
        found = connected_components(near_links(reps.where("id is not null"), block_masks(reps.count(), radius), radius))
        classes = reps.join(found, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("component", "id").alias("component_id"))
        return kept(prints.join(classes, names, "inner"))


def hex_digits(*words: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(w), 16, "0") for w in words)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    Null, empty and blank texts share fingerprint zero and are linked like any other; very long texts are read
    whole; repeated rows are members of one component; an empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession) as kept:
        prints = saved(fingerprints(docs, id_col, text_col, shingle))
        return kept(components(prints, radius).select(F.col("id").alias("doc_id"), hex_digits("w0").alias("fingerprint"), "component_id"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, shingles): the distinct hashes of each text's runs of words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, shingles array<long>")


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _sets_of(table: pa.Table) -> tuple[dict[int, list[np.ndarray]], pa.Table]:
    """The sets of each id, from the rows that hold one, and the other rows."""
    holds = table.column("shingles").is_valid()
    members, of = table.filter(holds), {}
    for i, shingles in zip(members.column("id").to_pylist(), members.column("shingles"), strict=True):
        of.setdefault(i, []).append(shingles.values.to_numpy())
    return of, table.filter(pc.invert(holds))


def _similar_within(table: pa.Table, similarity: float) -> pa.Table:
    """Of the pairs (id, other) in the table, those whose sets have at least this Jaccard similarity."""
    of, pairs = _sets_of(table)
    both = set(zip(pairs.column("id").to_pylist(), pairs.column("other").to_pylist(), strict=True))
    found = [(a, b) for a, b in both if any(_alike(u, v, similarity) for u in of.get(a, []) for v in of.get(b, []))]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _linked_within(table: pa.Table, names: list[str], masks: list[tuple[int, int]], wide: int, similarity: float, bound: int | None = None) -> pa.Table:
    """Every candidate of rows sorted by cell, verified on the sets unless its classes are linked already: the links that join classes.

    At most about `bound` candidates (HELD_PAIRS) are held: they are verified, the nearest first, before more are looked for."""
    of, rows = _sets_of(table)
    _, code = np.unique(rows.column("c").to_numpy(), return_inverse=True)
    above, ids, links = list(range(len(code))), rows.column("id").to_pylist(), []
    held: list[tuple[np.ndarray, ...]] = []
    weight, bound = 0, HELD_PAIRS if bound is None else bound

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    def verify() -> None:
        x, y, d = (np.concatenate(z) for z in zip(*held, strict=True))
        held.clear()
        label = np.array([top(k) for k in range(len(above))], np.int64)
        apart = np.nonzero(label[code[x]] != label[code[y]])[0]
        order = apart[np.lexsort((y[apart], x[apart], d[apart]))]
        for i, j, p, q in zip(x[order].tolist(), y[order].tolist(), code[x[order]].tolist(), code[y[order]].tolist(), strict=True):
            p, q = top(p), top(q)
            if p != q and any(_alike(u, v, similarity) for u in of.get(ids[i], []) for v in of.get(ids[j], [])):
                above[max(p, q)] = min(p, q)
                links.append((ids[i], ids[j]))

    for found in _candidates(rows, names, masks, wide) if rows.num_rows else ():
        held.append(found)
        weight += len(found[0])
        if weight > bound:
            verify()
            weight = 0
    if held:
        verify()
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _with_sets(rows: DataFrame, ends: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """rows, and the sets of `ends` (id, t, v, x, y), dealt and sorted by cell. Only texts that ends name are hashed, and a set moves
    once for each cell that names it, however many pairs do."""
    ends = saved(ends.distinct())
    sent = F.broadcast if ends.count() <= BROADCAST_NODES else lambda x: x
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sent(ends.select("id").distinct()), "id", "left_semi")
    sets = saved(shingle_sets(named, "id", "text", shingle)).join(sent(ends), "id").select("id", "shingles", *CELL)
    return _by_cell(sets.unionByName(rows, allowMissingColumns=True))


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, t, v, x, y) whose texts have at least this Jaccard similarity."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return per_key(batches, CELL, lambda table: _similar_within(table, similarity))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), *CELL)
    rows = _with_sets(pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), *CELL), ends, docs, id_col, text_col, shingle)
    return rows.mapInArrow(work, "a long, b long").distinct()


def _class_joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (w0 ..., id, c) after links (a, b) between ids: only the classes that links touch are joined."""
    if links.isEmpty():
        return classes
    class_of = classes.select(F.col("id").alias("node"), F.col("c").alias("of"))
    left = links.join(class_of, F.col("a") == F.col("node")).select(F.col("of").alias("a"), "b")
    joined = connected_components(left.join(class_of, F.col("b") == F.col("node")).select("a", F.col("of").alias("b")))
    others = [F.col(x) for x in classes.columns if x != "c"]
    return saved(classes.join(joined, F.col("c") == F.col("node"), "left").select(*others, F.coalesce("component", "c").alias("c")))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, n_words: int = 8, recall: float = 0.98, asked: int = 1, most: int = 1024) -> DataFrame:
    """(id, component_id) of rows with ids that are not null, over links of at least this Jaccard similarity of runs of words.

    The distance of the fingerprints of distinct shingles estimates the similarity, with a standard error that 64 * n_words bits make small.
    Pairs up to ERRORS errors beyond the threshold are candidates, and links only if the texts' own shingles say so; those beyond are none.
    A class first asks about its nearest pair with each of the `asked` nearest other classes. The rows of the pairs left out, where these still
    join different classes, then meet again in their cells together with their sets, where every pair is verified, the nearest first, unless links
    found there join it already: no pair leaves its task. The first masks go before the others, so that what they join is not asked about again in every table.
    Masks are sampled so that a pair at the threshold is met with probability `recall`, nearer ones oftener. Equal fingerprints are one node.
    Null, empty and blank texts are copies of one another; texts of fewer words than a shingle have one shingle, all their words; very long texts
    are read whole; rows that repeat an id are one node each and get the class of all of them. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    names = [f"w{k}" for k in range(n_words)]
    bits = 64 * n_words
    middle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    error = math.sqrt(middle * (1 - middle) / bits)
    wide = math.floor(bits * (middle + ERRORS * error))
    with scratch(spark) as kept:
        prints = saved(fingerprints(docs, id_col, text_col, shingle, n_words, distinct=True).where("id is not null"))
        reps = saved(prints.groupBy(*names).agg(F.min("id").alias("id")))
        masks = sampled_masks(reps.count(), n_words, middle, recall)
        classes = reps.withColumn("c", F.col("id"))
        for first, end in zip(steps := [0, *FIRST_TABLES, len(masks)], steps[1:], strict=False):
            upto = masks[:end]

            def nearest(batches: Iterable[pa.RecordBatch], upto: list = upto) -> Iterator[pa.RecordBatch]:
                return per_key(batches, CELL, lambda table: _graded_within(table, names, upto, wide, asked))

            def rest(batches: Iterable[pa.RecordBatch], upto: list = upto) -> Iterator[pa.RecordBatch]:
                return per_key(batches, CELL, lambda table: _linked_within(table, names, upto, wide, similarity))

            found = saved(_dealt(classes, upto, most, first).mapInArrow(nearest, "a long, b long, kind int, " + CELL_TYPES))
            pairs = found.where(F.col("kind") == ASK).select("a", "b", *CELL)
            if not pairs.isEmpty():
                classes = _class_joined(classes, saved(verified(pairs, docs, id_col, text_col, shingle, similarity)))
            more = found.where(F.col("kind") == MORE).select(F.col("a").alias("id"), F.col("b").cast("int").alias("own"), *CELL)
            apart = Window.partitionBy(*CELL)
            more = more.join(classes, "id").withColumn("apart", F.min("c").over(apart) < F.max("c").over(apart)).where("apart").drop("apart")
            more = saved(more)
            if not more.isEmpty():
                links = _with_sets(more, more.select("id", *CELL), docs, id_col, text_col, shingle).mapInArrow(rest, "a long, b long")
                classes = _class_joined(classes, saved(links))
        return kept(prints.join(classes.select(*names, F.col("c").alias("component_id")), names).select("id", "component_id"))


def kept_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, n_words: int = 8, recall: float = 0.98) -> DataFrame:
    """docs without those whose component has a smaller id: one document of each group of near copies stays.

    Of rows that repeat an id, the least stays if the id does: by all columns in order, maps as their sorted entries; a row whose id is null
    always stays. Of null, empty and blank texts one stays. Columns and their order are those of docs, whatever their names; an empty table
    gives no rows.
    """
    found = similar_components(docs, id_col, text_col, shingle, similarity, n_words, recall)
    again = saved(found.groupBy("id").count().where(F.col("count") > 1).select("id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = lambda ids: F.col(f"`{id_col}`").cast("long") == ids
    if not again.isEmpty():
        twice = again.select(F.col("id").alias(free_name(docs.columns, "twice")))
        own = docs.join(twice, same(F.col(twice.columns[0])), "left_semi").select(F.struct(*columns).alias("row"))
        order = F.struct(*(F.array_sort(F.map_entries(f"row.`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.to_json(F.struct(f"row.`{f.name}`")) if _unordered(f.dataType) else F.col(f"row.`{f.name}`") for f in docs.schema))
        least = own.groupBy(F.col(f"row.`{id_col}`").cast("long").alias("of_id")).agg(F.min_by("row", order).alias("row"))
        docs = docs.join(twice, same(F.col(twice.columns[0])), "left_anti").select(*columns).unionByName(least.select("row.*"))
    gone = saved(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(free_name(docs.columns, "gone"))).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    return docs.join(gone, same(F.col(gone.columns[0])), "left_anti").select(*columns)


def _unordered(kind: T.DataType) -> bool:
    """Whether values of this type hold a map somewhere, or are of a type without an order."""
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind)
    return isinstance(kind, T.MapType | T.VariantType)
