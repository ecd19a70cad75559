"""Best-fit packing of whole documents, partition by partition, then of what stayed underfull in a tree of merged lanes.

A partition packs what it holds by best fit, the longest pieces first, and emits the bins that come out nearly full. The pieces of
the others are the items of the next round: lanes of a bounded number of items do the same, lanes merge as items grow fewer,
and the last round emits every bin. Only lengths travel; the pieces of nearly full bins never leave their partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import per_key, saved, scratch, text_batches
from ledgerlark.llm.packing import SEQUENCE_BITS, SLICE, loaded

LONGEST = 1024
#: Free tokens of a bin that counts as nearly full.
NEARLY = 8
#: Tokens that a partition packs at once, and items of a lane.
HELD_TOKENS, LANE = 1 << 21, 1 << 16


def best_fit(lengths: list[int], size: int = LONGEST) -> tuple[list[list[int]], list[int]]:
    """The places of lengths in each bin, and what is left free: each length, from the longest to the shortest, goes to the bin
    with the least room that holds it. Of equal ones the earlier first."""
    bins: list[list[int]] = []
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[i]
        if fitting := rooms >> length:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), size
            bins.append([])
            free.append(size)
        bins[b].append(i)
        free[b] = room - length
        if free[b]:
            by_room[free[b]].append(b)
            rooms |= 1 << free[b]
    return bins, free


def cut(total: int, size: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: itself, or a shorter first piece and then whole ones."""
    first = total if total <= size else total % size
    return [(0, first)] * bool(first) + [(s, size) for s in range(first, total, size)]


def _cut_and_packed(docs: DataFrame, path: str, end: int, size: int, nearly: int, held_tokens: int) -> DataFrame:
    """A row for each piece, with a sequence and offset if its bin is nearly full, else with an item's number."""
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "item"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(path), TaskContext.get().partitionId() << SEQUENCE_BITS
        kind, waiting, out, made, items = pa.int64(), [], [], 0, 0  # waiting: pieces (doc, piece, start, ids)

        def placed(pieces: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for doc, piece, start, ids in pieces:
                out.append((doc, piece, start, len(ids), ids.astype("<u4").tobytes(), part | made, offset, None))
                offset += len(ids)
            made += 1

        def packed(last: bool) -> None:
            nonlocal waiting, items
            own, waiting = waiting, []
            bins, free = best_fit([len(p[3]) for p in own], size)
            for places, left in zip(bins, free, strict=True):
                if left <= nearly:
                    placed([own[i] for i in places])
                else:
                    waiting += [own[i] for i in places]
            if last or sum(len(p[3]) for p in waiting) > held_tokens // 2:
                for doc, piece, start, ids in waiting:
                    out.append((doc, piece, start, len(ids), ids.astype("<u4").tobytes(), None, None, part | items))
                    items += 1
                waiting = []

        def rows() -> Iterator[pa.RecordBatch]:
            kinds = [kind, pa.int32(), *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            for k in range(0, len(out), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[k : k + SLICE], strict=True), kinds, strict=True)], names)
            out.clear()

        tokens = 0
        for own, texts in text_batches(batches, "text", SLICE):
            kind = own.column("id").type
            for doc, text in zip(own.column("id").to_pylist(), texts, strict=True):
                ids = np.append(bpe.encode(text or ""), np.uint32(end))
                for n, (start, length) in enumerate(cut(len(ids), size)):
                    piece = doc, n, start, ids[start : start + length]
                    if length == size:
                        placed([piece])
                    else:
                        waiting.append(piece)
                tokens += len(ids)
                if tokens > held_tokens:
                    packed(False)
                    tokens = sum(len(p[3]) for p in waiting)
                    yield from rows()
        packed(True)
        yield from rows()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long, item long")


def merged(items: DataFrame, size: int = LONGEST, nearly: int = NEARLY, lane: int = LANE) -> DataFrame:
    """(item, sequence_id, offset) of items (item, length): rounds of best fit over lanes of about `lane` items.

    The number of lanes is a power of two, and an item's lane of fewer lanes is the remainder of its old one, so that whole lanes merge.
    The last round is that of one lane, or the one after which lanes would not grow fewer."""
    found, lanes, turn = [], 0, 0
    opened = items.select("item", "length")
    while many := opened.count():
        want = 1 << (-(-many // lane) - 1).bit_length()
        last = want == 1 or lanes and want >= lanes
        lanes = min(want, lanes) if lanes else want

        def work(batches: Iterable[pa.RecordBatch], turn: int = turn, last: bool = bool(last)) -> Iterator[pa.RecordBatch]:
            def packed(table: pa.Table) -> pa.Table:
                table = table.sort_by([("length", "descending"), ("item", "ascending")])
                lengths, first = table.column("length").to_pylist(), table.column("lane")[0].as_py()
                sequence, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
                for b, (places, left) in enumerate(zip(*best_fit(lengths, size), strict=True)):
                    if last or left <= nearly:
                        sequence[places] = b
                        offset[places] = np.cumsum([0, *(lengths[i] for i in places[:-1])])
                number = -1 - (turn << 56 | first << 24) - sequence  # below zero: none of a partition's own
                return pa.table([table.column("item"), table.column("length"), pa.array(number, mask=sequence < 0), pa.array(offset)], ["item", "length", "sequence_id", "offset"])

            return per_key(batches, ["lane"], packed)

        dealt = opened.withColumn("lane", F.pmod(F.xxhash64("item"), F.lit(lanes)))
        dealt = dealt.coalesce(1) if lanes == 1 else dealt.repartition(lanes, "lane").sortWithinPartitions("lane")
        done = saved(dealt.mapInArrow(work, "item long, length long, sequence_id long, offset long"))
        found.append(done.where("sequence_id is not null").select("item", "sequence_id", "offset"))
        if last:
            break
        opened, turn = done.where("sequence_id is null").select("item", "length"), turn + 1
    none = items.sparkSession.createDataFrame([], "item long, sequence_id long, offset long")
    return reduce(DataFrame.unionByName, found) if found else none


def packed(docs: DataFrame, path: str, end: int = 2, size: int = LONGEST, nearly: int = NEARLY, held_tokens: int = HELD_TOKENS, lane: int = LANE, id_col: str = "doc_id", text_col: str = "text", then=lambda pieces: pieces) -> DataFrame:
    """What `then` makes of (doc_id, piece, start, length, ids, sequence_id, offset) of each piece, as a table: few sequences of at most `size` ids.

    A document's ids are the vocabulary's and then `end`; ids has those of the piece as little-endian unsigned 32-bit integers.
    Documents of at most `size` ids stay whole; of a longer one the first piece may be shorter. A null or empty text is
    the one id `end`; a very long text is cut as it comes and its whole pieces leave at once; rows that repeat an id and null
    ids, of any type, are packed as they are; an empty table gives no rows; other columns are not read, whatever their names.
    A partition holds at most about `held_tokens` ids, a lane `lane` lengths.
    """
    with scratch(docs.sparkSession) as kept:
        pieces = saved(_cut_and_packed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), path, end, size, nearly, held_tokens))
        places = merged(pieces.where("item is not null").select("item", "length"), size, nearly, lane)
        full = pieces.where("item is null").drop("item")
        rest = pieces.where("item is not null").drop("sequence_id", "offset").join(places, "item").select(full.columns)
        return kept(then(full.unionByName(rest)))
