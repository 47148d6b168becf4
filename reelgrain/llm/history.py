"""New batches against everything accepted before, by a persistent chunk-to-record table.

The content of an entry is its digest, its sample_id and four 64-bit frame hashes. The first two are whole chunks. The 256
bits of the frame hashes are dealt to nine chunks in turn (bit b to chunk b mod 9), so that one flat or repeated frame
takes seven bits from each chunk and fixes none. Rolling-hash boundaries cannot give the required rows: up to 24 differing
bits may touch every content-defined chunk (`content_chunks`; its measured recall is in the README). The rest of the
method stands: chunk keys, a persistent table from chunk to record, a decision by coverage (at least 232 of 256 bits
shared), and an append of the accepted entries' chunks.

No pair is lost. Of 24 differing bits one of seven chunks holds at most two or one of two others at most one, as three in
each of the seven and two in each of the two are 25. The history stores one row per chunk; a batch's row probes the two-bit
or one-bit neighbourhood of each of its keys (28 or 29 bits) and compares what it meets in full, there and then. A pair is given by
the first chunk that shows it, so pairs come out once.

The table is parted by chunk and by the first `bits` bits of the key. A batch's rows go to their own part and to those at
most two bits away; the history is not shuffled: a task reads the row groups of its own parts. `bits` follows the number of
entries (one more for each doubling beyond a million), set anew by `compact`, so that a part holds some half a million rows
however long the history grows. An entry takes about 0.45 KB in the chunk table.

Equal values of a batch meet as one key with the least entry_id, never as pairs. For each key a task looks for matches in
the history and for near keys of a lesser id in the batch, up to `MOST_LESSER` of these and `MOST_PAIRS` in a part, so that
a large group of near copies costs its size and not its square. Entries that met nothing are accepted. Where no key met more, the others are
decided in order of entry_id by one task, whose rows are bounded as below. Where some did, they are decided in rounds: an
entry without a match in the history or a lesser one in the batch is accepted, its chunks are appended, and the others are
held against the new chunks; one that is neither accepted nor refused then has only refused ones before it and enters the
next round. Batches above `MOST_ROWS` rows are taken in slices by entry_id, which is the order of decision anyway, so that
a task's share is bounded even where a third of all rows share a key.

A commit is written last and holds all of a slice, with its refusals and the greatest entry_id decided. Rows up to that id
are decided already and left out, so that a batch that was broken off can be given again.

Defined results. A digest that is not 64 hex digits however written, a null sample_id and hash lists other than four
times 16 hex digits match nothing. Entry ids are distinct and
ascend from batch to batch; rows with a null id are left out. An empty batch changes
nothing. added_at plays no part.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator, Sequence
from functools import cache, reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reelgrain.functions.text import digest_hex, trimmed_lower
from reelgrain.session import data_files, read_small, remove, scratch, store, write_small, written

RADIUS, CHUNKS, FLIPS = 24, 9, 2
#: Bits in which a chunk's keys may differ. With one more in each, 25 bits would differ.
FLIPPED = (FLIPS,) * 7 + (1,) * 2
DIGEST, SAMPLE, SLOTS = CHUNKS, CHUNKS + 1, CHUNKS + 2
WIDTHS = tuple(len(range(c, 256, CHUNKS)) for c in range(CHUNKS))
BLOCK, MOST_ROWS, CAPACITY, MOST_PARTS, TOGETHER = 1024, 1 << 20, 1 << 20, 64, 8
#: Lesser near keys told of a key, pairs told of a part, runs met as a whole, probes at a time.
MOST_LESSER, MOST_PAIRS, SHORT, PROBES = 4096, 1 << 20, 256, 1 << 16
KEYS = ("bits", "dig", "sid")
ENTRY = "entry_id bigint, bits binary, dig binary, sid binary"
PAIR = "accepted_id bigint, refused_id bigint, kind string"
#: What a key has met: more rows of its own than its least (the record), a near key of a lesser id (the record), a record of the table, more lesser ones than are given.
EQUAL, LESSER, RECORD, MORE = 0, 1, 2, 3
MET = "kind int, value binary, what int, record bigint"


def chunk_keys(raw: np.ndarray) -> np.ndarray:
    """9 x n keys of n x 32 bytes."""
    bits = np.unpackbits(raw, axis=1)
    out = np.zeros((CHUNKS, len(raw)), np.uint32)
    for c in range(CHUNKS):
        padded = np.zeros((len(raw), 32), np.uint8)
        padded[:, 32 - WIDTHS[c] :] = bits[:, c::CHUNKS]
        out[c] = np.packbits(padded, axis=1).view(">u4")[:, 0]
    return out


def mixed(words: np.ndarray) -> np.ndarray:
    """64 bits of n x 4 words, the first ones even."""
    h = words[:, 0].copy()
    for i in range(1, 4):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[:, i]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@cache
def neighbours(flips: int) -> np.ndarray:
    """For each place in a word of 64 cells, the bits of the places at most `flips` bits away."""
    return np.array([sum(1 << (low ^ int(m)) for m in masks(6, flips)) for low in range(64)], np.uint64)


@cache
def masks(width: int, flips: int) -> np.ndarray:
    """All words of `width` bits with at most `flips` ones, the fewest first."""
    return np.array([sum(1 << b for b in ones) for n in range(flips + 1) for ones in combinations(range(width), n)], np.uint32)


class Rows:
    """ids, keys, values (n x 4 words) and flags of some chunks, in columns."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, words: np.ndarray, many: np.ndarray):
        self.ids, self.keys, self.words, self.many = ids, keys, words, many

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.keys[at], self.words[at], self.many[at])

    def pack(self, keyed: bool) -> bytes:
        """The keys of digests and sample_ids follow from their values and are not stored."""
        base = int(self.ids.min())
        wide = int(self.ids.max()) - base >= 1 << 32
        ids = (self.ids - base).astype("<u8" if wide else "<u4")
        keys = self.keys.astype("<u4").tobytes() if keyed else b""
        return struct.pack("<qq??", len(self), base, wide, keyed) + ids.tobytes() + keys + self.words.tobytes() + np.packbits(self.many).tobytes()

    @staticmethod
    def unpack(blob: bytes) -> Rows:
        n, base, wide, keyed = struct.unpack_from("<qq??", blob)
        at = 18
        ids = np.frombuffer(blob, "<u8" if wide else "<u4", n, at).astype(np.int64) + base
        at += n * (8 if wide else 4)
        keys = np.frombuffer(blob, "<u4", n, at) if keyed else None
        at += 4 * n * keyed
        words = np.frombuffer(blob, "<u8", 4 * n, at).reshape(n, 4)
        many = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at + 32 * n), count=n).astype(bool)
        return Rows(ids, mixed(words) if keys is None else keys, words, many)

    @staticmethod
    def joined(parts: Sequence[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, a) for p in parts]) for a in ("ids", "keys", "words", "many")))


def near_pairs(own: Rows, q: np.ndarray, rows: Rows, t: np.ndarray, radius: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (place in own, place in rows) that differ in at most `radius` bits, and their keys in at most `flips`. The first word leaves few of others."""
    at = np.flatnonzero(np.bitwise_count(own.words[:, 0][q] ^ rows.words[:, 0][t]) <= radius)
    q, t = q[at], t[at]
    at = np.flatnonzero(np.bitwise_count(own.keys[q] ^ rows.keys[t]) <= flips)
    q, t = q[at], t[at]
    near = np.bitwise_count(own.words[q] ^ rows.words[t]).sum(axis=1, dtype=np.int16) <= radius
    return q[near], t[near]


def shown_first(a: np.ndarray, b: np.ndarray, chunk: int) -> np.ndarray:
    """Whether no chunk before this one shows the near pairs."""
    new = np.ones(len(a), bool)
    if len(a) and chunk:
        differ = np.unpackbits((a ^ b).view(np.uint8), axis=1)
        for c in range(chunk):
            new &= differ[:, c::CHUNKS].sum(axis=1) > FLIPPED[c]
    return new


def expanded(at: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of `at` beside each place from `first` to before `end`."""
    size = (end - first).astype(np.int64)
    q = np.repeat(at, size)
    return q, np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(q))


class Index:
    """Rows of one part of the table by cells of their keys, those of a cell in the order in which they are given.

    Held cells are bits in words of 64 neighbours, so that one word tells all cells that differ in its six low bits; the
    place of a cell among the held ones is a count of bits.
    """

    def __init__(self, rows: Rows, width: int):
        self.width = width
        self.bits = min(width, max(8, min(24, int(len(rows)).bit_length() + 5)))
        self.rest = np.uint32(width - self.bits)
        cells = self.cells(rows.keys)
        order = np.sort(cells.astype(np.uint64) << np.uint64(32) | np.arange(len(rows), dtype=np.uint64))
        cells, order = (order >> np.uint64(32)).astype(np.uint32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.rows = rows.take(order)
        self.starts = np.concatenate([np.flatnonzero(np.diff(cells.astype(np.int64), prepend=-1)), [len(rows)]]).astype(np.int32)
        held = np.zeros(1 << self.bits, bool)
        held[cells] = True
        self.words = np.packbits(held, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint32((1 << self.width) - 1)) >> self.rest

    def runs(self, cells: np.ndarray, flips: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries and the runs of rows in the cells at most `flips` bits away, some ten thousand probes at a time."""
        for lo in range(0, len(cells), PROBES):
            part = cells[lo : lo + PROBES]
            high, low = (part >> np.uint32(6)).astype(np.int64), part & np.uint32(63)
            every = masks(self.bits - 6, flips).astype(np.int64)
            ones = np.bitwise_count(every)
            step = max(1, PROBES // len(part))
            for n in range(flips + 1):
                beside = neighbours(flips - n)[low]
                some = every[ones == n]
                for at in range(0, len(some), step):
                    to = some[at : at + step, None] ^ high[None, :]
                    left = (self.words[to] & beside).ravel()
                    hit = np.flatnonzero(left != 0)
                    to, left, q = to.ravel()[hit], left[hit], lo + hit % len(part)
                    while len(q):
                        one = left & (~left + np.uint64(1))  # the lowest bit
                        cell = self.before[to] + np.bitwise_count(self.words[to] & (one - np.uint64(1)))
                        yield q, self.starts[cell], self.starts[cell + 1]
                        left = left ^ one
                        more = np.flatnonzero(left)
                        to, left, q = to[more], left[more], q[more]

    def lesser(self, own: Rows, flips: int, radius: int, chunk: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `own` and ids of near rows with a lesser id, and the places that have more than `most` of them. The rows are given in order of id.

        Short runs are met as a whole, long ones a step at a time, so that members of a large group stop when they have
        met enough. Where the pairs exceed `MOST_PAIRS`, each place stops at its first and none is told.
        """
        found, rows = np.zeros(len(own), np.int64), self.rows
        places, records, told = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def met(q: np.ndarray, t: np.ndarray) -> None:
            nonlocal told
            q, t = near_pairs(own, q, rows, t, radius, FLIPPED[chunk])
            before = rows.ids[t] < own.ids[q]
            q, t = q[before], t[before]
            np.add.at(found, q, 1)
            if told <= MOST_PAIRS:
                new = shown_first(own.words[q], rows.words[t], chunk)
                places.append(q[new])
                records.append(rows.ids[t[new]])
                told += len(q)

        for at, first, end in self.runs(self.cells(own.keys), flips):
            short = end - first <= SHORT
            met(*expanded(at[short], first[short], end[short]))
            at, first, end = at[~short], first[~short], end[~short]
            while len(at):
                on = (found[at] <= (most if told <= MOST_PAIRS else 0)) & (first < end) & (rows.ids[np.minimum(first, len(rows) - 1)] < own.ids[at])
                at, first, end = at[on], first[on], end[on]
                met(at, first)
                first = first + 1
        if told > MOST_PAIRS:
            return places[0], records[0], np.flatnonzero(found)
        return np.concatenate(places), np.concatenate(records), np.flatnonzero(found > most)

    def pairs(self, own: Rows, flips: int, radius: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in `own` and ids of the near rows that no chunk before this one shows."""
        places, records, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], self.rows
        for at, first, end in self.runs(self.cells(own.keys), flips):
            step = max(1, int(PROBES * len(at) // max(1, (end - first).sum())))
            for lo in range(0, len(at), step):
                q, t = expanded(at[lo : lo + step], first[lo : lo + step], end[lo : lo + step])
                q, t = near_pairs(own, q, rows, t, radius, FLIPPED[chunk])
                new = shown_first(own.words[q], rows.words[t], chunk)
                places.append(q[new])
                records.append(rows.ids[t[new]])
        return np.concatenate(places), np.concatenate(records)


def equal_pairs(own: Rows, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Places in `own` and ids of rows with the same value."""
    rows = rows.take(np.argsort(rows.keys))
    first, end = np.searchsorted(rows.keys, own.keys, "left"), np.searchsorted(rows.keys, own.keys, "right")
    q, t = expanded(np.arange(len(own)), first, end)
    same = (own.words[q] == rows.words[t]).all(axis=1)
    return q[same], rows.ids[t[same]]


def spread(keys: DataFrame, bits: int, home: bool, flips: Sequence[int] = (FLIPS,) * CHUNKS) -> DataFrame:
    """part, blob: the chunks of (kind, value, vid, many), packed by the parts of the table where they are stored (`home`) or looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slot_rows(slot: int, rows: Rows, width: int) -> Iterator[tuple[int, bytes]]:
            own = (rows.keys >> rows.keys.dtype.type(width - bits)).astype(np.int64) if bits else np.zeros(len(rows), np.int64)
            for mask in masks(bits, 0 if home or slot >= CHUNKS else min(bits, flips[slot])):
                to = own ^ int(mask)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
                for a, b in zip(cuts, cuts[1:]):
                    for lo in range(int(a), int(b), BLOCK):
                        at = order[lo : min(lo + BLOCK, int(b))]
                        yield int(to[at[0]]) * SLOTS + slot, rows.take(at).pack(slot < CHUNKS)

        def packed(held: list[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
            t = pa.Table.from_batches(held)
            kinds, ids, many = (t.column(i).to_numpy() for i in (0, 2, 3))
            raw = np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint8).reshape(-1, 32)
            for kind in range(len(KEYS)):
                at = np.flatnonzero(kinds == kind)
                if not len(at):
                    continue
                words = np.ascontiguousarray(raw[at]).view("<u8")
                whole = Rows(ids[at], None, words, many[at].astype(bool))  # type: ignore[arg-type]
                if kind == 0:
                    for c, own in enumerate(chunk_keys(raw[at])):
                        whole.keys = own
                        yield from slot_rows(c, whole, WIDTHS[c])
                else:
                    whole.keys = mixed(words)
                    yield from slot_rows(CHUNKS + kind - 1, whole, 64)

        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = packed(held)
            # only what is stored has an order; copies for many parts leave as they are packed and are never held together
            rows = iter(sorted(rows, key=lambda x: x[0])) if home else rows
            while part := list(islice(rows, 512)):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.binary())], names=["part", "blob"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 100_000:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return keys.select("kind", "value", "vid", "many").mapInArrow(run, "part int, blob binary")


class Stored:
    """Reader of chunk files: row groups are chosen by their range of parts. A file that is not there is an error."""

    def __init__(self, files: Sequence[str]):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.files = []
        for uri in files:
            store, path = fs.FileSystem.from_uri(uri)
            f = pq.ParquetFile(store.open_input_file(path))
            groups = [f.metadata.row_group(i).column(0).statistics for i in range(f.num_row_groups)]
            self.files.append((f, [(s.min, s.max) for s in groups]))

    def read(self, part: int) -> list[Rows]:
        out = []
        for f, ranges in self.files:
            for i, (low, high) in enumerate(ranges):
                if low <= part <= high:
                    t = f.read_row_group(i)
                    out += [Rows.unpack(b.as_py()) for b in t.column(1).filter(pc.equal(t.column(0), part))]
        return out


def probe(keys: DataFrame, bits: int, files: Sequence[str], own: bool, radius: int, most: int = MOST_LESSER) -> DataFrame:
    """kind, value, what, record of all that the keys (kind, value, vid, many) meet in the table's files and, with `own`, among themselves."""
    files = list(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Rows]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(part, []).append(Rows.unpack(blob.as_py()))
        stored = Stored(files) if held else None
        for part in sorted(held):
            bucket, slot = divmod(part, SLOTS)
            rows = Rows.joined(held.pop(part))
            kind = max(0, slot - CHUNKS + 1)
            old = stored.read(part)
            out: list[tuple[np.ndarray, int, np.ndarray | None]] = []
            if slot >= CHUNKS:
                if own:
                    at = np.flatnonzero(rows.many)
                    out.append((at, EQUAL, rows.ids[at]))
                if old:
                    q, record = equal_pairs(rows, Rows.joined(old))
                    out.append((q, RECORD, record))
            else:
                low = WIDTHS[slot] - bits
                away = np.bitwise_count((rows.keys >> np.uint32(low)) ^ np.uint32(bucket))
                at_home = np.flatnonzero(away == 0)
                if own and slot == 0:
                    at = at_home[rows.many[at_home]]
                    out.append((at, EQUAL, rows.ids[at]))
                targets = [("own", Index(rows.take(at_home[np.argsort(rows.ids[at_home])]), low))] if own and len(at_home) else []
                targets += [("old", Index(Rows.joined(old), low))] if old else []
                for n in range(FLIPPED[slot] + 1):
                    at = np.flatnonzero(away == n)
                    at = at[np.argsort(rows.keys[at])]
                    if not len(at):
                        continue
                    mine = rows.take(at)
                    for which, index in targets:
                        if which == "own":
                            q, record, more = index.lesser(mine, FLIPPED[slot] - n, radius, slot, most)
                            out += [(at[q], LESSER, record), (at[more], MORE, None)]
                        else:
                            q, record = index.pairs(mine, FLIPPED[slot] - n, radius, slot)
                            out.append((at[q], RECORD, record))
            for at, what, record in out:
                for lo in range(0, len(at), 50_000):
                    q = at[lo : lo + 50_000]
                    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(q), [None, pa.py_buffer(rows.words[q].tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), kind, np.int32)), values.cast(pa.binary()), pa.array(np.full(len(q), what, np.int32)), pa.nulls(len(q), pa.int64()) if record is None else pa.array(record[lo : lo + 50_000])],
                        names=["kind", "value", "what", "record"],
                    )

    # a key goes to more parts the more bits there are: tasks grow alike, so that the share held by one does not
    copies = math.ceil(len(masks(bits, min(FLIPS, bits))) / 4)
    tasks = min(SLOTS << bits, 4 * copies * keys.sparkSession.sparkContext.defaultParallelism)
    rows = spread(keys, bits, False, FLIPPED)
    return rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).mapInArrow(run, MET)


def normalised(manifest: DataFrame) -> DataFrame:
    """entry_id, bits, dig, sid: 32 bytes each of the frame hashes, the digest and the sample_id's hash, null where they are not whole."""
    joined = F.array_join(F.transform("frame_hashes", trimmed_lower), ",")
    rows = manifest.filter("entry_id is not null").select("entry_id", F.unhex(digest_hex("video_sha256")).alias("dig"), F.unhex(F.sha2(F.col("sample_id").cast("string"), 256)).alias("sid"), joined.alias("j"))
    whole = F.col("j").rlike(r"\A[0-9a-f]{16}(?:,[0-9a-f]{16}){3}\z")
    return rows.select("entry_id", F.when(whole, F.unhex(F.replace("j", F.lit(",")))).alias("bits"), "dig", "sid")


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("entry_id", F.inline(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("value")) for i, k in enumerate(KEYS))))).filter("value is not null")


def keys_of(long: DataFrame) -> DataFrame:
    """One row for each (kind, value), with its least entry_id and whether there are more."""
    return long.groupBy("kind", "value").agg(F.min("entry_id").alias("vid"), (F.count(F.lit(1)) > 1).alias("many"))


def settle(touched: DataFrame) -> DataFrame:
    """The refusals among entries that met something and whom they repeat, in order of entry_id.

    touched: entry_id, kind, value, what, record of every key of theirs that met something, all in one task. An entry that
    only others met is accepted unless another of its keys is here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[int, bytes], int] = {}
        keys: dict[int, set[int]] = {}  # of an entry
        exact: set[int] = set()  # keys of digests and sample_ids
        first: dict[int, int] = {}  # the least entry of a key of hashes: all of a key's entries are here
        near: dict[int, set[int]] = {}  # the lesser entries that a key of hashes met
        old: dict[int, dict[int, bool]] = {}  # whether the record of an entry is met by hashes alone
        for batch in batches:
            for e, kind, value, what, record in zip(*(c.to_pylist() for c in batch.columns)):
                key = number.setdefault((kind, value), len(number))
                if kind:
                    exact.add(key)
                keys.setdefault(e, set()).add(key)
                if what == RECORD:
                    met = old.setdefault(e, {})
                    met[record] = met.get(record, True) and kind == 0
                elif what == LESSER:
                    near.setdefault(key, set()).add(record)
                if kind == 0:
                    first[key] = min(first.get(key, e), e)
        rows, least = [], {e: key for key, e in first.items()}
        beside: dict[int, set[int]] = {}
        for key, lesser in near.items():
            for e in lesser:
                other = least.get(e)
                if other is None:
                    other = least[e] = len(number) + len(least)  # a key that met nothing itself
                    keys.setdefault(e, set()).add(other)
                beside.setdefault(key, set()).add(other)
                beside.setdefault(other, set()).add(key)
        taken: dict[int, int] = {}  # the accepted entry of a key
        for e in sorted(keys):
            met = old.get(e, {})
            for key in keys[e]:
                for other in beside.get(key, ()):
                    if other in taken:
                        met.setdefault(taken[other], True)
            for key in keys[e]:
                if key in taken:
                    met[taken[key]] = key not in exact and met.get(taken[key], True)
            if met:
                rows += [(a, e, "near" if alone else "exact") for a, alone in met.items()]
            else:
                for key in keys[e]:
                    taken[key] = e
        for lo in range(0, len(rows), 50_000):
            part = list(zip(*rows[lo : lo + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2])], names=["accepted_id", "refused_id", "kind"])

    return touched.select("entry_id", "kind", "value", "what", "record").repartition(1).mapInArrow(run, PAIR)


class History:
    """Accepted entries, their chunk table and all refusals, under one folder.

    Part k is committed by the file commits/k, which names its chunk files, its number of entries, the bits by which its
    chunks are parted, the greatest entry_id decided and the parts that it replaces. Another History over the same folder
    starts from the committed parts. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bits: int | None = None, radius: int = RADIUS):
        if not 0 <= radius <= RADIUS:
            raise ValueError("two flips in one of nine chunks cover at most 24 differing bits")
        if bits is not None and not 0 <= bits <= 16:
            raise ValueError("the table is parted by 0 to 16 bits")
        self.spark, self.path, self.radius = spark, path or scratch(spark, "history"), radius
        commits = {int(k): json.loads(text) for k, text in read_small(spark, f"{self.path}/commits").items()}
        gone = {p for c in commits.values() for p in c["replaces"]}
        self.parts = {k: c for k, c in sorted(commits.items()) if k not in gone}
        self.decided = sorted(k for k, c in commits.items() if c["refused"])
        self.next = 1 + max(commits, default=-1)
        self.last = max((c["last"] for c in commits.values()), default=None)
        stored = {c["bits"] for c in self.parts.values()}
        if len(stored) > 1 or bits is not None and stored - {bits}:
            raise ValueError(f"the store is parted by {sorted(stored)} bits")
        self.bits = min(stored, default=bits or 0)
        self.steps: list[str] = []

    @property
    def size(self) -> int:
        return sum(c["rows"] for c in self.parts.values())

    def accepted(self) -> DataFrame:
        """entry_id, bits, dig, sid of all accepted entries."""
        return self.spark.read.schema(ENTRY).parquet(*(f"{self.path}/entries/{k}/*" for k in self.parts)) if self.parts else self.spark.createDataFrame([], ENTRY)

    def refused(self, parts: Sequence[int] | None = None) -> DataFrame:
        """accepted_id, refused_id, kind of all refused entries."""
        paths = [f"{self.path}/refused/{k}" for k in (self.decided if parts is None else parts)]
        return self.spark.read.schema(PAIR).parquet(*paths) if paths else self.spark.createDataFrame([], PAIR)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Decide a batch, append what it adds and return its refusals: accepted_id, refused_id, kind."""
        if self.last is not None:
            batch = batch.filter(F.col("entry_id") > self.last)
        kept: list[str] = []
        seen, place = Observation(), self.next
        rows = written(normalised(batch).observe(seen, F.count(F.lit(1)).alias("n"), F.max("entry_id").alias("top")), "batch", paths=kept)
        n, top = seen.get["n"], seen.get["top"]
        slices = math.ceil(n / MOST_ROWS)
        cuts = sorted({int(c) for c in rows.approxQuantile("entry_id", [i / slices for i in range(1, slices)], 0.1 / slices)}) if slices > 1 else []
        for low, high in zip([None, *cuts], [*cuts, None]) if n else ():
            part = rows if low is None else rows.filter(F.col("entry_id") > low)
            self._decide(part if high is None else part.filter(F.col("entry_id") <= high), top if high is None else high)
        remove(self.spark, kept[0])
        return self.refused([k for k in self.decided if k >= place])

    def compact(self) -> None:
        """All parts as one, parted by as many bits as its number of entries asks for."""
        old = list(self.parts)
        if old:
            k, whole = self._begin(), self.accepted()
            self.bits = max(self.bits, math.ceil(math.log2(max(1, 2 * self.size / CAPACITY))))
            n, files = self._store(k, 0, whole)
            self._commit(k, {"rows": n, "files": files, "replaces": old, "last": self.last, "refused": False})
            for k in old:
                for part in ("entries", "chunks"):
                    remove(self.spark, f"{self.path}/{part}/{k}")

    def drop(self) -> None:
        remove(self.spark, self.path)

    def _begin(self) -> int:
        k, self.next = self.next, self.next + 1
        for part in ("entries", "chunks", "refused"):
            remove(self.spark, f"{self.path}/{part}/{k}")  # of a part that was not committed
        return k

    def _commit(self, k: int, facts: dict) -> None:
        commit = {"bits": self.bits, **facts}
        write_small(self.spark, f"{self.path}/commits/{k}", json.dumps(commit))
        self.parts = {p: c for p, c in self.parts.items() if p not in commit["replaces"]} | {k: commit}
        self.last = commit["last"]
        if commit["refused"]:
            self.decided.append(k)

    def _store(self, k: int, turn: int, taken: DataFrame) -> tuple[int, list[str]]:
        """Write accepted entries and their chunks; how many they are, and the chunk files."""
        seen = Observation()
        store(taken.observe(seen, F.count(F.lit(1)).alias("n")), f"{self.path}/entries/{k}/{turn}")
        stored, n = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/{k}/{turn}"), seen.get["n"]
        keys = exploded(stored.coalesce(1 + n // 200_000)).select("kind", "value", F.col("entry_id").alias("vid"), F.lit(False).alias("many"))
        # row groups of some 512 KB in order of part, their size looked at after each few blobs, so that a reader takes little more than its own
        small = {"compression": "uncompressed", "parquet.block.size": str(1 << 19), "parquet.page.size.row.check.min": "4", "parquet.enable.dictionary": "false"}
        store(spread(keys, self.bits, True), f"{self.path}/chunks/{k}/{turn}", **small)
        return n, data_files(self.spark, f"{self.path}/chunks/{k}/{turn}")

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        """Cut lineage through a table that lives until the slice is done."""
        return written(df, name, paths=self.steps)

    def _decide(self, rows: DataFrame, last: int) -> None:
        """Accept and refuse a slice's rows, up to entry_id `last`, in rounds and commit the result."""
        if self.size > CAPACITY << self.bits or len(self.parts) > MOST_PARTS:
            self.compact()
        k, old, seen = self._begin(), [f for c in self.parts.values() for f in c["files"]], Observation()
        met = probe(keys_of(exploded(rows)), self.bits, old, True, self.radius)
        met = self._step(met.observe(seen, F.count_if(F.col("what") == MORE).alias("more")), "met")
        if seen.get["more"]:
            n, files = self._rounds(k, rows, met)
        else:
            store(settle(exploded(rows).join(met, ["kind", "value"])), f"{self.path}/refused/{k}")
            lost = self.refused([k]).select(F.col("refused_id").alias("entry_id"))
            n, files = self._store(k, 0, rows.join(lost, "entry_id", "left_anti"))
        self._commit(k, {"rows": n, "files": files, "replaces": [], "last": last, "refused": True})
        while self.steps:
            remove(self.spark, self.steps.pop())

    def _rounds(self, k: int, rows: DataFrame, met: DataFrame) -> tuple[int, list[str]]:
        """Store part k's accepted and refused entries where keys met more than can be told at once."""
        pending, turn, n, files, found, held = rows, 0, 0, [], [], None
        while True:
            touched = self._step(exploded(pending).join(met, ["kind", "value"]), "touched")
            if held is None:
                held = touched.select("entry_id", "kind", "value").distinct()
                found.append(touched.filter(f"what = {RECORD}").select(F.col("record").alias("accepted_id"), F.col("entry_id").alias("refused_id"), (F.col("kind") == 0).alias("near")))
            waits = F.bool_or(F.col("what").isin(LESSER, MORE) | (F.col("what") == EQUAL) & (F.col("entry_id") > F.col("record")))
            state = touched.groupBy("entry_id").agg(F.bool_or(F.col("what") == RECORD).alias("refused"), waits.alias("waits"))
            added, new = self._store(k, turn, pending.join(state.filter("refused or waits"), "entry_id", "left_anti"))
            n, files = n + added, files + new
            reached = probe(keys_of(held), self.bits, new, False, self.radius)
            pairs = held.join(reached, ["kind", "value"]).filter("record < entry_id")
            pairs = self._step(pairs.select(F.col("record").alias("accepted_id"), F.col("entry_id").alias("refused_id"), (F.col("kind") == 0).alias("near")), "pairs")
            found.append(pairs)
            left = state.filter("waits and not refused").join(pairs.select(F.col("refused_id").alias("entry_id")), "entry_id", "left_anti")
            pending = self._step(pending.join(left, "entry_id", "left_semi"), "pending")
            turn += 1
            if pending.isEmpty():
                break
            met = self._step(probe(keys_of(exploded(pending)), self.bits, [], True, self.radius, 0), "met")
        kinds = reduce(DataFrame.unionByName, found).groupBy("accepted_id", "refused_id").agg(F.when(F.bool_and("near"), "near").otherwise("exact").alias("kind"))
        store(kinds, f"{self.path}/refused/{k}")
        return n, files


def refusals(manifest: DataFrame) -> DataFrame:
    """The refusals of a whole manifest, decided and appended batch by batch in a store of its own.

    What a batch costs at least does not fall with its size. So consecutive ones are taken together while all of them are
    less than an eighth of the history; the order of decision is that of entry_id either way.
    """
    ids = manifest.filter("entry_id is not null")
    batches = sorted((r.top, r.n) for r in ids.groupBy("batch_no").agg(F.max("entry_id").alias("top"), F.count(F.lit(1)).alias("n")).collect())  # a row per batch
    history = History(manifest.sparkSession)
    after, n = None, 0
    for (end, rows), (_, following) in zip(batches, [*batches[1:], (None, math.inf)]):
        n += rows
        if n + following > min(MOST_ROWS, history.size // TOGETHER):
            part = ids.filter(F.col("entry_id") <= end)
            history.ingest(part if after is None else part.filter(F.col("entry_id") > after))
            after, n = end, 0
    return history.refused()


def content_chunks(value: bytes, mask: int = 3, window: int = 2) -> list[bytes]:
    """Content-defined chunks of a value: a boundary where the rolling hash of the last `window` bytes ends in zeros."""
    out, start = [], 0
    for i in range(len(value)):
        rolling = reduce(lambda h, b: (h * 263 + b + 1) & 0xFFFFFFFF, value[max(0, i + 1 - window) : i + 1], 0)
        if (rolling >> 7) & mask == 0 or i + 1 == len(value):
            out.append(value[start : i + 1])
            start = i + 1
    return out
