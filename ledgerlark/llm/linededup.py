"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

Line hashes are counted over all documents; those in enough documents are dealt to shards of bounded size, and a
task for each shard builds a minimal perfect hash: bit arrays, level by level, in which each hash that falls alone
on a bit sets it; the rank of its bit is its index into a compact array of fingerprints and one of counts.
Documents are never joined with lines: they probe the arrays, which reach them in broadcasts of proven size.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.common import WORD_SPACE, dropped, free_name, saved, text_batches

STRIP = WORD_SPACE.encode()
SHARD_KEYS = 32_768
LEVELS = 40
MIX = np.uint64(0xD6E8FEB86659FD93)


def line_hashes(text: str | None, least: int = 1) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines, the hash of each line's key and whether the key has at least so many code points."""
    lines = (text or "").encode().split(b"\n")
    keys = [x.strip(STRIP).lower() for x in lines]
    counted = [len(k) > 0 for k in keys] if least <= 1 else [len(k.decode()) >= least for k in keys]
    digest = xxhash.xxh64_intdigest
    return lines, np.fromiter((digest(k) for k in keys), np.uint64, len(keys)), np.array(counted, bool)


def document_counts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """(h, n): in how many rows of docs each line hash occurs. Counted in each batch before the shuffle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_batches([batch], "text", 4096):
                own = []
                for t in texts:
                    _, h, ok = line_hashes(t, least)
                    own.append(np.unique(h[ok]))
                h, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * int(MIX) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def build_shard(h: np.ndarray, n: np.ndarray) -> bytes:
    """Bit arrays of all levels, their sizes, and the fingerprints and counts in the order of the bits' ranks."""
    left = np.arange(len(h))
    sizes, bits, placed = [], [], []
    while len(left):
        size = max(64, math.ceil(1.6 * len(left) / 64) * 64)
        if len(sizes) >= LEVELS - 8:
            size = max(1024, size * len(left))  # the last few keys: a level so wide that none can stay
        at = _mixed(h[left], len(sizes)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        own = alone[at.astype(np.int64)]
        order = np.argsort(at[own])
        placed.append(left[own][order])
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~own]
        if len(sizes) > LEVELS:
            raise ValueError("equal line hashes in a shard")
    rank = np.concatenate(placed)
    out = io.BytesIO()
    key = h[rank]
    np.savez(out, sizes=np.array(sizes, np.int64), bits=np.concatenate(bits), low=(key & np.uint64(0xFFFFFFFF)).astype(np.uint32), high=(key >> np.uint64(48)).astype(np.uint16), n=np.minimum(n[rank], 2**32 - 1).astype(np.uint32))
    return out.getvalue()


class LineIndex:
    """Consecutive shards from `first` on, ready for probes."""

    def __init__(self, first: int, shards: int, blobs: list[bytes]):
        parts = [np.load(io.BytesIO(b)) for b in blobs]
        self.first, self.shards, self.n_here = first, shards, len(parts)
        self.bits = np.concatenate([p["bits"] for p in parts])
        self.low, self.high, self.n = (np.concatenate([p[k] for p in parts]) for k in ("low", "high", "n"))
        depth = max(len(p["sizes"]) for p in parts)
        self.size = np.zeros((len(parts), depth), np.int64)
        self.base = np.zeros((len(parts), depth), np.int64)
        at = 0
        for k, p in enumerate(parts):
            for level, size in enumerate(p["sizes"].tolist()):
                self.size[k, level], self.base[k, level] = size, at
                at += size
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])

    def count(self, h: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 if these shards don't have it."""
        out = np.zeros(len(h), np.int64)
        shard = (h % np.uint64(self.shards)).astype(np.int64) - self.first
        left = np.nonzero((shard >= 0) & (shard < self.n_here))[0]
        for level in range(self.size.shape[1]):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.base[shard[left], level] + (_mixed(h[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            index = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            key = h[left[hit]]
            same = (self.low[index] == (key & np.uint64(0xFFFFFFFF))) & (self.high[index] == key >> np.uint64(48))
            out[left[hit][same]] = self.n[index[same]]
            left = left[~hit]
        return out


def text_counts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """(h, n): in how many different texts of docs each line hash occurs; rows with equal texts count once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text", 4096):
            own = {xxhash.xxh64_intdigest((t or "").encode()) - (1 << 63): t for t in texts}
            lines = []
            for t in own.values():
                _, h, ok = line_hashes(t, least)
                lines.append(np.unique(h[ok]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(lines, pa.list_(pa.int64()))], ["t", "lines"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "t long, lines array<long>")
    return rows.groupBy("t").agg(F.first("lines").alias("lines")).select(F.explode("lines").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def index_shards(docs: DataFrame, text_col: str, min_docs: int, least: int, copies: bool = True) -> tuple[DataFrame, int]:
    """(shard, blob) over the distinct hashes of lines in at least min_docs documents, and the number of shards."""
    counts = document_counts(docs, text_col, least) if copies else text_counts(docs, text_col, least)
    common = saved(counts.where(F.col("n") >= min_docs))
    shards = max(1, math.ceil(common.count() / SHARD_KEYS))
    shard = F.expr(f"cast(pmod(pmod(shiftrightunsigned(h, 1), {shards}L) * 2 + (h & 1), {shards}L) as int)")  # the unsigned hash modulo shards

    def build(key: tuple, table: pa.Table) -> pa.Table:
        blob = build_shard(table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return saved(common.select(shard.alias("shard"), "h", "n").groupBy("shard").applyInArrow(build, "shard int, blob binary")), shards


def without_common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, least: int = 1, broadcast_bytes: int = 64 << 20, stats: tuple[str, str] | None = None, copies: bool = True) -> DataFrame:
    """docs whose texts lack all lines with a key that occurs in at least min_docs rows.

    A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends, with A-Z in lower case; keys of fewer
    than `least` code points never count. The other lines stay as they are, joined by \\n. A null text becomes
    the empty text (one empty line); texts that lose all their lines become empty; a row counts as a document,
    repeated rows included (with copies=False rows of equal texts are one document); an empty table gives no rows; texts of any length are read whole.
    Columns and their order stay, whatever their names; stats names two more columns, lines before and lines dropped, each with an underscore before it
    where docs has one of that name.
    The arrays reach the documents in as many passes as keep each broadcast under broadcast_bytes; only more than
    one pass writes the texts between.
    """
    blobs, shards = index_shards(docs, text_col, min_docs, least, copies)
    sizes = {r["shard"]: r["b"] for r in blobs.select("shard", F.length("blob").alias("b")).collect()}
    groups: list[list[int]] = [[]]
    room = 0
    for k in sorted(sizes):
        if groups[-1] and (room + sizes[k] > broadcast_bytes or k != groups[-1][-1] + 1):
            groups.append([])
            room = 0
        groups[-1].append(k)
        room += sizes[k]
    names = docs.columns
    stats = tuple(free_name(names, s) for s in stats or ())
    at = names.index(text_col)
    typed = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
    flag = free_name(names, "dropped_lines")
    rows = typed.withColumn(flag, F.lit(None).cast("binary"))
    context = docs.sparkSession.sparkContext
    for k, group in enumerate(groups):
        own = [r["blob"] for r in blobs.where(F.col("shard").between(group[0], group[-1])).orderBy("shard").collect()] if group else []
        sent = context.broadcast((group[0] if group else 0, shards, own))
        last = k == len(groups) - 1
        extra = list(stats) if last else [flag]
        schema = T.StructType([*typed.schema.fields, *(T.StructField(c, T.BinaryType() if c == flag else T.LongType()) for c in extra)])

        def work(batches: Iterable[pa.RecordBatch], sent=sent, last=last, extra=extra) -> Iterator[pa.RecordBatch]:
            first, shards, own = sent.value
            index = LineIndex(first, shards, own) if own else None
            for part, texts in text_batches(batches, text_col):
                flags = part.column(part.num_columns - 1).to_pylist()
                split = [line_hashes(t, least) for t in texts]
                every = np.concatenate([h for _, h, _ in split]) if split else np.empty(0, np.uint64)
                found = index.count(every) >= min_docs if index else np.zeros(len(every), bool)
                kept, total, gone, marks, i = [], [], [], [], 0
                for (lines, _, ok), before in zip(split, flags, strict=True):
                    drop = found[i : i + len(lines)] & ok
                    i += len(lines)
                    if before is not None:
                        drop |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(lines)).astype(bool)
                    if last:
                        kept.append(b"\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d).decode())
                        total.append(len(lines))
                        gone.append(int(drop.sum()))
                    else:
                        marks.append(np.packbits(drop).tobytes())
                columns = part.columns[:-1]
                if last:
                    columns[at] = pa.array(kept, pa.string())
                    columns += [pa.array(x, pa.int64()) for x in (total, gone)] if extra else []
                else:
                    columns.append(pa.array(marks, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *extra])

        done, rows = rows, rows.mapInArrow(work, schema)
        if not last:
            rows = saved(rows)
            if k:
                dropped(done)
    return rows
