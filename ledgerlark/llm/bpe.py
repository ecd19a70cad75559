"""BPE encoding by contiguous rank arrays, and decoding.

All new words of a batch are merged together: a matrix holds the parts of the words of one length, a second one
the rank of each adjacent pair. Each turn finds every word's least rank, deletes the boundary there and refreshes
the ranks of the two neighbours. Words longer than SHORT bytes go through a heap instead.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm.common import text_batches

SHORT = 64
CACHED = 250_000
#: Beyond Latin, Greek and Cyrillic.
RARE = regex.compile(r"[^\x00-\u052f]")
NEVER = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable ones for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    """A vocabulary of the tokenizers library with a word-end suffix, its normaliser and its splitter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model, added = own["model"], own["added_tokens"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.span = int(max(vocab.values())) + 1
        key = left * self.span + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made[order].astype(np.int32)
        self.pairs: dict[int, tuple[int, int]] = {}
        self._table()
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [""] * (max(self.span, *self.special.values()) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.between = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        steps = own["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.path, self.library, self.bytes_of = path, None, {s: b for b, s in enumerate(symbols)}
        self.cache: dict[str, bytes] = {}

    def _table(self) -> None:
        """An open table of merges: one array access finds most pairs."""
        self.mask = (1 << 19) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        at, todo, self.probes = self._home(self.keys), np.arange(len(self.keys)), 0
        while len(todo):
            free = self.slot[at[todo]] < 0
            self.slot[at[todo][free]] = todo[free]
            todo = todo[self.slot[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * -7046029254386353131) >> 40) & self.mask

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of the merge of each pair, or -1."""
        key = left.astype(np.int64) * self.span + right
        at = self._home(key)
        found = self.slot[at]
        out = np.where((found >= 0) & (self.keys[found] == key), found, -1)
        open_ = np.nonzero((found >= 0) & (out < 0))[0]
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot[at[open_]]
            hit = (found >= 0) & (self.keys[found] == key[open_])
            out[open_[hit]] = found[hit]
            open_ = open_[(found >= 0) & ~hit]
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of one length."""
        parts = self.first[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        parts[:, -1] = self.final[[w[-1] for w in words]]
        out: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))
        if parts.shape[1] > 1:
            pair = self._find(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
            rank = np.where(pair >= 0, self.ranks[pair], NEVER)
        while parts.shape[1] > 1 and len(rows):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), at]
            over = least == NEVER
            if over.any():
                width = parts.shape[1] * 4
                flat = parts[over].astype("<u4").tobytes()
                for k, r in enumerate(rows[over].tolist()):
                    out[r] = flat[k * width : (k + 1) * width]
                rows, parts, rank, at = rows[~over], parts[~over], rank[~over], at[~over]
                if not len(rows):
                    break
            row = np.arange(len(rows))
            merged = self.made[self._find(parts[row, at], parts[row, at + 1])]
            n = parts.shape[1] - 1
            grid = np.arange(n)[None, :]
            parts = np.take_along_axis(parts, grid + (grid > at[:, None]), axis=1)
            parts[row, at] = merged
            grid = np.arange(n - 1)[None, :]
            rank = np.take_along_axis(rank, grid + (grid >= at[:, None]), axis=1)
            for ok, i in ((at > 0, at - 1), (at < n - 1, at)):
                r, i = row[ok], i[ok]
                pair = self._find(parts[r, i], parts[r, i + 1])
                rank[r, i] = np.where(pair >= 0, self.ranks[pair], NEVER)
        for k, r in enumerate(rows.tolist()):
            out[r] = parts[k].astype("<u4").tobytes()
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one word of any length, in n log n steps."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        pairs, span = self.pairs, self.span
        part = self.first[np.frombuffer(word, np.uint8)].tolist()
        part[-1] = int(self.final[word[-1]])
        n = len(part)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[key][0], i, key) for i in range(n - 1) if (key := part[i] * span + part[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = ahead[i]
            if part[i] < 0 or j >= n or part[i] * span + part[j] != key:
                continue
            part[i], part[j], ahead[i] = pairs[key][1], -1, ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for x, y in ((behind[i], i), (i, ahead[i])):
                if x >= 0 and y < n and (key := part[x] * span + part[y]) in pairs:
                    heapq.heappush(heap, (pairs[key][0], x, key))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words into the cache."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        by_length: dict[int, list[str]] = {}
        coded = {}
        for w in words:
            if w not in self.cache:
                coded[w] = w.encode()
                by_length.setdefault(len(coded[w]), []).append(w)
        for length, own in by_length.items():
            if length > SHORT:
                ids = [self.merge_long(coded[w]) for w in own]
            else:
                ids = [x for k in range(0, len(own), 8192) for x in self.merge_short([coded[w] for w in own[k : k + 8192]])]
            self.cache.update(zip(own, ids, strict=True))

    def split(self, text: str) -> list[str]:
        """Words of the normalised text, and special tokens as they stand."""
        out: list[str] = []
        for k, piece in enumerate(self.between.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(piece)
                continue
            if RARE.search(piece):
                out += self.split_rare(piece)
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            out += self.words.findall(piece.lower())
        return out

    def split_rare(self, text: str) -> list[str]:
        """The words of a text with letters whose classes differ between Unicode versions: those that the library knows."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, symbols)).decode() for symbols, _ in pieces]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t or "") for t in texts]
        new = set().union(*split) - self.special.keys() if split else set()
        self.learn(new)
        known = self.cache | {t: int(i).to_bytes(4, "little") for t, i in self.special.items()} if any(w in self.special for own in split for w in own) else self.cache
        return [b"".join(map(known.__getitem__, own)) for own in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the library writes them where a vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded from these ids.

    A null text is the empty text, without tokens. Texts of any length are encoded whole. Rows stay as they are,
    repeated ones and null ids included; an empty table gives no rows; other columns are not read.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part, texts in text_batches(batches, "text", 1024):
            ids = bpe.encode_batch(texts)
            columns = [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bpe.decode(x) for x in ids] if decode else [None] * len(ids), pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
