"""Byte-level BPE of whole texts with a public vocabulary of ranks.

Merging uses a rank queue over a hierarchical bitmap: a bucket for each merge rank holds the linked-list positions
whose pair has that rank, find-first-set over three levels of 64-bit words gives the least rank with a bucket, and
entries that a merge has outdated are skipped when they come up. A pre-token of n bytes takes O(n log n) steps however
long it is. Merged pre-tokens are kept in a bounded cache.

Defined results. Null and empty texts have no ids. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern that parts a text before merging, as the vocabulary's publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES, CACHE_BYTES = 200_000, 64


class RankQueue:
    """Positions by rank, least rank first, leftmost position first."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0  # a bit for each word of mid; Python's integers have no width to overrun
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        word = (a << 6) | ((m & -m).bit_length() - 1)
        w = self.low[word]
        rank = (word << 6) | ((w & -w).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[word >> 6] &= ~(1 << (word & 63))
                if not self.mid[word >> 6]:
                    self.top &= ~(1 << (word >> 6))
        return rank, position


class Encoder:
    def __init__(self, vocabulary: bytes):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.lengths = array("i", [0]) * (max(self.ranks.values(), default=0) + 1)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        pattern = regex.compile(PATTERN)
        self.pieces, self.pieces_between = pattern.findall, pattern.finditer
        self.queue = RankQueue(len(self.lengths))
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks, queue = self.ranks, self.queue
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # the rank of the pair that starts here
        get, push = ranks.get, queue.push
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                pair[i] = r
                push(r, i)
        while (item := queue.pop()) is not None:
            r, i = item
            if pair[i] != r:
                continue
            j = end[i]
            k = end[i] = end[j]
            pair[j] = None
            if k < n:
                before[k] = i
                pair[i] = x = get(piece[i : end[k]])
                if x is not None:
                    push(x, i)
            else:
                pair[i] = None
            if (h := before[i]) >= 0:
                pair[h] = x = get(piece[h:k])
                if x is not None:
                    push(x, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if not text:
            return ids
        cache, extend = self.cache, ids.extend
        for piece in self.pieces(text):
            found = cache.get(piece)
            if found is None:
                raw = piece.encode("utf-8", "surrogatepass")
                found = self.merge(raw)
                if len(raw) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = found
            extend(found)
        return ids


    def encode_parts(self, text: str) -> tuple[array, list[int], list[int]]:
        """ids, and of each pre-token its first character and its first id; both lists end with the whole's length."""
        ids, starts, firsts, at = array("i"), [], [], 0
        cache, extend = self.cache, ids.extend
        for piece in self.pieces(text):
            starts.append(at)
            firsts.append(len(ids))
            at += len(piece)
            found = cache.get(piece)
            extend(self.encode(piece) if found is None else found)
        starts.append(at)
        firsts.append(len(ids))
        return ids, starts, firsts


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids of every row. The vocabulary (under a megabyte, of fixed size) is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                flat, offsets = array("i"), array("i", [0])
                for t in part.column(1):
                    flat.extend(encode(t.as_py()))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(memoryview(offsets) if len(offsets) else [], pa.int32()), pa.array(memoryview(flat) if len(flat) else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} bigint, ids array<int>")
