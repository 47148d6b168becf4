"""Evaluation texts that appear in a corpus, as a prefix-filtered set join.

Every window of an item (12 consecutive words, or all words of a shorter item) is a sequence of word shingles (five
words, or all of a shorter window). Shingles are ordered by rarity over the whole corpus; a document that contains a
window contains its rarest shingle, so one prefix token a window is enough to join on. A joined place gives the place
where the window would start; it must lie within the document (positional and length bounds), and all shingles of the
window must follow at their places, which is exact containment.

Stage one reads the documents once and keeps, for those that hold any item shingle, the places of these shingles (in a
table in the shared folder). The item side is the stated query set; it is taken in blocks of bounded size, so what goes
to the tasks does not grow with it, and nothing of the corpus goes to the driver but a count per item shingle.

Defined results. Null, empty and wordless texts contain and are contained in nothing. Repeated documents each count by
their id; equal ids give one row. Words are runs of letters and digits after NFKC, in lower case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.session import written

WINDOW, SHINGLE, BLOCK_WORDS, AT_ONCE = 12, 5, 200_000, 4
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


@dataclass
class Block:
    """The windows of a block of items. A shingle is an id; a window a row of shingle ids, -1 after its end."""

    vocabulary: dict[str, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # words of a shingle -> its word ids, its shingle ids
    windows: np.ndarray
    lengths: np.ndarray  # words of each window
    owners: list[list[int]]  # items of each window


def build(items: list[tuple[int, list[str]]], window: int = WINDOW, shingle: int = SHINGLE) -> Block:
    vocabulary: dict[str, int] = {}
    shingles: dict[tuple[int, ...], int] = {}
    found: dict[tuple[int, ...], tuple[int, set[int]]] = {}
    for item, tokens in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in tokens]
        if not ids:
            continue
        n = min(window, len(ids))
        k = min(shingle, n)
        own = [shingles.setdefault(tuple(ids[i : i + k]), len(shingles)) for i in range(len(ids) - k + 1)]
        for i in range(len(ids) - n + 1):
            found.setdefault(tuple(own[i : i + n - k + 1]), (n, set()))[1].add(item)
    width = max((len(w) for w in found), default=1)
    rows = np.full((len(found), width), -1, np.int64)
    for r, w in enumerate(found):
        rows[r, : len(w)] = w
    by_length = {}
    for k in {len(s) for s in shingles}:
        own = [(s, i) for s, i in shingles.items() if len(s) == k]
        by_length[k] = (np.array([s for s, _ in own], np.int64), np.array([i for _, i in own], np.int64))
    return Block(vocabulary, by_length, rows, np.array([n for n, _ in found.values()], np.int64), [sorted(o) for _, o in found.values()])


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word ids."""
    h = np.zeros(len(ids), np.uint64)
    for c in range(ids.shape[1]):
        h = (h ^ (ids[:, c].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _places(block: Block, tables: dict, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a batch: words before each document, places of item shingles in the whole batch, their ids."""
    get = block.vocabulary.get
    streams, starts = [], [0]
    for t in texts:
        own = [get(w, -1) for w in t]
        streams.append(np.array(own, np.int64))
        starts.append(starts[-1] + len(own))
    ids, starts = np.concatenate([*streams, np.zeros(0, np.int64)]), np.array(starts, np.int64)
    document = np.repeat(np.arange(len(texts)), np.diff(starts))
    places, found = [], []
    for k, (hashes, order_words, order_ids) in tables.items():
        if len(ids) < k:
            continue
        ok = document[: len(ids) - k + 1] == document[k - 1 :]
        for c in range(k):
            ok &= ids[c : len(ids) - k + 1 + c] >= 0
        at = np.flatnonzero(ok)
        own = ids[at[:, None] + np.arange(k)]
        slot = np.minimum(np.searchsorted(hashes, _mix(own)), len(hashes) - 1)
        same = (order_words[slot] == own).all(axis=1)
        places.append(at[same])
        found.append(order_ids[slot[same]])
    none = np.zeros(0, np.int64)
    places, found = np.concatenate([*places, none]), np.concatenate([*found, none])
    order = np.argsort(places, kind="stable")
    return starts, places[order], found[order]


def _tables(block: Block) -> dict:
    out = {}
    for k, (w, i) in block.by_length.items():
        h = _mix(w)
        order = np.argsort(h)
        if (h[order][1:] == h[order][:-1]).any():
            raise ValueError("two item shingles share a hash")  # 64 bits over a bounded block
        out[k] = (h[order], w[order], i[order])
    return out


def shingle_places(documents: DataFrame, blocks: Block | Sequence[Block], key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, key, n_words, places, shingles: a row per block and document that holds any of its shingles. A document is read and parted into words once for all blocks."""
    shared = documents.sparkSession.sparkContext.broadcast([blocks] if isinstance(blocks, Block) else list(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(block, _tables(block)) for block in shared.value]
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                texts = [words(t) for t in batch.column(1).to_pylist()]
                for number, (block, tables) in enumerate(own):
                    starts, places, found = _places(block, tables, texts)
                    cuts = np.searchsorted(places, starts)
                    held = np.flatnonzero(np.diff(cuts))
                    local = places - np.repeat(starts[:-1], np.diff(cuts))
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.diff(cuts)[held])]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (local, found)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number, np.int32)), batch.column(0).take(pa.array(held)), pa.array(np.diff(starts)[held]), *lists], names=["block", key, "n_words", "places", "shingles"])

    return documents.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"block int, {key} bigint, n_words bigint, places array<int>, shingles array<int>")


def verified(places: DataFrame, block: Block, counts: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, item_id of exact containments, from each window's rarest shingle."""
    windows = block.windows
    filled = np.where(windows >= 0, counts[windows], np.iinfo(np.int64).max)
    offset = filled.argmin(axis=1) if len(windows) else np.zeros(0, np.int64)
    prefix = windows[np.arange(len(windows)), offset]
    order = np.argsort(prefix, kind="stable")
    first = np.searchsorted(prefix[order], np.arange(len(counts) + 1))
    owners = np.array([o for own in block.owners for o in own], np.int64)
    owner_at = np.concatenate([[0], np.cumsum([len(o) for o in block.owners])]).astype(np.int64)
    shared = places.sparkSession.sparkContext.broadcast((windows, block.lengths, offset, order, first, owners, owner_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, lengths, offset, order, first, owners, owner_at = shared.value
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            per = np.diff(batch.column(2).offsets.to_numpy())
            document = np.repeat(np.arange(batch.num_rows), per)
            place = batch.column(2).flatten().to_numpy().astype(np.int64)
            shingle = batch.column(3).flatten().to_numpy().astype(np.int64)
            # word places of shorter items' shingles can coincide with longer ones': look up by (place, shingle)
            held = np.sort((base[document] + place) * len(counts) + shingle)
            many = first[shingle + 1] - first[shingle]
            row = np.repeat(np.arange(len(place)), many)
            within = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            w = order[first[shingle[row]] + within]
            start = place[row] - offset[w]
            ok = (start >= 0) & (start + lengths[w] <= sizes[document[row]])
            row, w, start = row[ok], w[ok], start[ok]
            ok = np.ones(len(w), bool)
            for j in range(windows.shape[1]):
                want = windows[w, j]
                code = (base[document[row]] + start + j) * len(counts) + want
                at = np.minimum(np.searchsorted(held, code), max(len(held) - 1, 0))
                ok &= (want < 0) | (held[at] == code) if len(held) else want < 0
            document, w = document[row[ok]], w[ok]
            many = owner_at[w + 1] - owner_at[w]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.stack([np.repeat(document, many), owners[np.repeat(owner_at[w], many) + within]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], names=[key, "item_id"])

    return places.select(key, "n_words", "places", "shingles").mapInArrow(run, f"{key} bigint, item_id bigint")


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, at_once: int = AT_ONCE) -> DataFrame:
    """key, item_id: documents that hold a window of an item. The corpus is read once for each `at_once` blocks of items."""
    spark = documents.sparkSession
    parts, held, size = [], [], 0
    blocks: list[Block] = []

    def flush() -> None:
        places = written(shingle_places(documents, blocks, key), "places")
        counts = [np.zeros(max(sum(len(i) for _, i in b.by_length.values()), 1), np.int64) for b in blocks]
        for b, s, n in places.select("block", key, F.explode(F.array_distinct("shingles")).alias("s")).groupBy("block", "s").count().collect():  # a row per item shingle of the blocks
            counts[b][s] = n
        parts.extend(verified(places.filter(F.col("block") == b), block, counts[b], key) for b, block in enumerate(blocks))
        blocks.clear()

    for item, text in items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null").toLocalIterator():
        own = words(text)
        if held and size + len(own) > block_words:
            blocks.append(build(held, window, shingle))
            held, size = [], 0
            if len(blocks) >= at_once:
                flush()
        held.append((item, own))
        size += len(own)
    if held:
        blocks.append(build(held, window, shingle))
    if blocks:
        flush()
    if not parts:
        return spark.createDataFrame([], f"{key} bigint, item_id bigint")
    return reduce(DataFrame.unionByName, parts).distinct()
