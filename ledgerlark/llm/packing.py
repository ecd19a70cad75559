"""Hierarchical packing of documents into sequences of several lengths.

A document of the longest context or more gives whole windows of it; what remains goes to the tier of the shortest
context that holds it. Tiers are packed from the longest down: each remainder opens a window, its gap takes the
largest whole pieces of shorter tiers that fit, and the last of the gap is cut to fit from one more piece. What finds
no filler is joined end to end and cut into whole windows. All lengths are powers of two and every window is full,
so that no sequence needs padding.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm.bpe import byte_symbols
from ledgerlark.llm.common import text_batches

TIERS = (64, 128, 256, 512, 1024)
#: Tokens of a step group: so many that every length divides it.
STEP_TOKENS = 16_384
SLICE = 1024
SEQUENCE_BITS = 38

Piece = tuple[int, int, int]  # document (its place among those held), start, length


class ByteBpe:
    """The ids of a byte-level vocabulary file, special tokens in a text included, by merges of byte ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in own["added_tokens"]}
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in own["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.library = path, None

    def encode(self, text: str) -> np.ndarray:
        try:
            if max(text, default="") < "԰":
                return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # the splitter's stack ends on a very long run of blanks
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


class Packer:
    """Packs pieces slice by slice; holds less than one longest window between slices."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("context lengths must be powers of two")
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # (length, document, start), sorted

    def route(self, piece: Piece) -> list[list[Piece]]:
        """Whole windows of the piece; the remainder waits in its tier."""
        doc, start, left = piece
        out = []
        while left >= self.longest:
            out.append([(doc, start, self.longest)])
            start, left = start + self.longest, left - self.longest
        if left:
            insort(self.waiting[next(t for t in self.tiers if t >= left)], (left, doc, start))
        return out

    def _filler(self, gap: int, below: int) -> Piece | None:
        """The largest waiting piece of a tier shorter than `below` that fits the gap, else part of a larger one."""
        for t in reversed([t for t in self.tiers if t < below]):
            if at := bisect_right(self.waiting[t], (gap, 1 << 62, 1 << 62)):
                length, doc, start = self.waiting[t].pop(at - 1)
                return doc, start, length
        for t in (t for t in self.tiers if t < below):
            if self.waiting[t]:
                length, doc, start = self.waiting[t].pop(0)
                self.route((doc, start + gap, length - gap))
                return doc, start, gap
        return None

    def pack(self) -> list[list[Piece]]:
        """Full windows of all that waits; less than one longest window goes on waiting."""
        out: list[list[Piece]] = []
        rest: list[Piece] = []
        for t in reversed(self.tiers):
            while self.waiting[t]:
                length, doc, start = self.waiting[t].pop()
                window, gap = [(doc, start, length)], t - length
                while gap and (more := self._filler(gap, t)):
                    window.append(more)
                    gap -= more[2]
                if gap:
                    rest += window
                else:
                    out.append(window)
        window, gap = [], self.longest
        for doc, start, length in rest:
            while length:
                take = min(gap, length)
                window.append((doc, start, take))
                start, length, gap = start + take, length - take, gap - take
                if not gap:
                    out.append(window)
                    window, gap = [], self.longest
        for piece in window:
            self.route(piece)
        return out

    def finish(self) -> list[list[Piece]]:
        """The last pieces in full windows whose lengths are the binary digits of their number of tokens."""
        left = [(doc, start, length) for t in self.tiers for length, doc, start in self.waiting[t]]
        self.waiting = {t: [] for t in self.tiers}
        total, out = sum(p[2] for p in left), []
        left.reverse()
        for k in range(total.bit_length() - 1, -1, -1):
            if not total >> k & 1:
                continue
            window, gap = [], 1 << k
            while gap:
                doc, start, length = left.pop()
                take = min(gap, length)
                window.append((doc, start, take))
                gap -= take
                if take < length:
                    left.append((doc, start + take, length - take))
            out.append(window)
        return out


COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]


def dealt(windows: list[list], groups: int) -> list[tuple[list, int]]:
    """Each window with its group: from the most pieces to the fewest, to and fro over the groups."""
    out = []
    for i, window in enumerate(sorted(windows, key=len, reverse=True)):
        turn, at = divmod(i, groups)
        out.append((window, groups - 1 - at if turn % 2 else at))
    return out


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_length, step_group) of each piece.

    A document's ids are the vocabulary's and then 0; ids has those of the piece as little-endian unsigned 32-bit
    integers. Each partition packs its own rows without a shuffle, and a lost task packs the same rows again, so that
    sequence_id (the partition in the high bits) is the same. Sequences of one length fill step groups of equal
    token numbers (STEP_TOKENS): those of a slice are dealt to its groups to and fro, from the most pieces to the fewest, so that
    groups differ by less than one sequence's pieces; sequences that fill no group go with the next slice's, and the last of a partition and length
    are a smaller group. A null or empty text is the one id 0; a very long text is cut into whole windows; repeated rows and null ids are packed as
    they are, ids of any type; an empty table gives no rows; other columns are not read.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = loaded(path), Packer(tiers)
        part = TaskContext.get().partitionId()
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        made = number = 0
        held: dict[int, list[list[tuple]]] = {}  # by length: sequences, as the rows of their pieces, that no step group has yet
        groups: dict[int, int] = {}
        kind = pa.int64()

        def rows(windows: list[list[Piece]], end: bool = False) -> pa.RecordBatch:
            nonlocal made
            out: list[tuple] = []
            for window in windows:
                own = [(names[doc], start, length, ids[doc][start : start + length].astype("<u4").tobytes(), len(ids[doc])) for doc, start, length in window]
                held.setdefault(sum(p[2] for p in window), []).append(own)
            for size, own in sorted(held.items()):
                per, first = max(1, STEP_TOKENS // size), groups.get(size, 0)
                full = len(own) // per
                for window, turn in [*dealt(own[: full * per], full), *((w, full) for w in own[full * per :] if end)]:
                    offset = 0
                    for name, start, length, piece, total in window:
                        out.append((name, start, length, piece, total, part << SEQUENCE_BITS | made, offset, size, f"{part}-{size}-{first + turn}"))
                        offset += length
                    made += 1
                held[size], groups[size] = own[full * per :], first + full
            kinds = (kind, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4, pa.string())
            columns = zip(*out, strict=True) if out else ((),) * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], COLUMNS)

        for own, texts in text_batches(batches, "text", SLICE):
            kind = own.column("id").type
            windows = []
            for name, text in zip(own.column("id").to_pylist(), texts, strict=True):
                ids[number], names[number] = np.append(bpe.encode(text or ""), np.uint32(0)), name
                windows += packer.route((number, 0, len(ids[number])))
                number += 1
            yield rows(windows + packer.pack())
            waiting = {doc for t in packer.tiers for _, doc, _ in packer.waiting[t]}
            ids, names = {k: ids[k] for k in waiting}, {k: names[k] for k in waiting}
        if number:
            yield rows(packer.finish(), end=True)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
