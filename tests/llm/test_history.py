import itertools
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from reelgrain.llm import history as h
from reelgrain.session import table

SCHEMA = "entry_id bigint, batch_no int, sample_id string, video_sha256 string, frame_hashes array<string>, bits string, vid string, kind string"


def words(v):
    return [f"{(v >> (64 * i)) & (2**64 - 1):016x}" for i in range(4)]


def brute(rows):
    accepted, out = [], set()
    for e, _, s, d, f in sorted(rows, key=lambda r: r[0]):
        d = d.strip().lower().removeprefix("sha256:") if d else None
        d = d if d and len(d) == 64 and all(c in "0123456789abcdef" for c in d) else None
        v = sum(int(x, 16) << (64 * i) for i, x in enumerate(f)) if f and len(f) == 4 and all(x and len(x) == 16 for x in f) else None
        hits = []
        for a, sa, da, va in accepted:
            if (d and d == da) or (s is not None and s == sa):
                hits.append((a, e, "exact"))
            elif v is not None and va is not None and (v ^ va).bit_count() <= 24:
                hits.append((a, e, "near"))
        if hits:
            out |= set(hits)
        else:
            accepted.append((e, s, d, v))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return {tuple(r) for r in h.refusals(df, **options).collect()}


def test_twenty_four_bits_leave_a_chunk_with_two():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (300, 32)).astype(np.uint8)
    other = base.copy()
    for k in range(300):
        # half of the cases spread the bits as evenly over the chunks as they can
        bits = rng.choice(256, 24, replace=False) if k % 2 else [c + h.CHUNKS * int(i) for c in range(h.CHUNKS) for i in rng.choice(28, 3, replace=False)][:24]
        for b in bits:
            other[k, b // 8] ^= 128 >> (b % 8)
    differ = np.bitwise_count(h.chunk_keys(base) ^ h.chunk_keys(other))
    assert (differ.min(axis=0) <= h.FLIPS).all() and (differ.sum(axis=0) == 24).all()
    assert sum(h.WIDTHS) == 256 and max(h.WIDTHS) == 29


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("top", [2**20, 2**45])
def test_packed_rows_come_back(keyed, top):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (1000, 4)).astype(np.uint64)
    rows = h.Rows(rng.integers(-5, top, 1000), rng.integers(0, 2**29, 1000).astype(np.uint32) if keyed else h.mixed(words), words, rng.random(1000) < 0.5)
    back = h.Rows.unpack(rows.pack(keyed))
    assert all((getattr(rows, a) == getattr(back, a)).all() for a in ("ids", "keys", "words", "many"))


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    base = [rng.getrandbits(256) for _ in range(6)]
    for e in range(160):
        kind = rng.random()
        v = rng.choice(base) if kind < 0.5 else rng.getrandbits(256)
        for b in rng.sample(range(256), rng.choice([0, 3, 12, 24, 25, 30])):
            v ^= 1 << b
        digest = f"{rng.randrange(60):064x}" if rng.random() < 0.4 else f"{rng.getrandbits(256):064x}"
        digest = rng.choice([digest, digest.upper(), f" sha256:{digest} ", None, "n/a", digest[:-1]])
        frames = words(v) if rng.random() < 0.9 else rng.choice([None, [], words(v)[:3], [*words(v)[:3], None], [*words(v)[:3], "zz"]])
        rows.append((e * 3, e // 20, rng.choice([None, f"s{rng.randrange(80)}", f"t{e}"]), digest, frames))
    assert run(spark, rows) == brute(rows)


def random_rows(n, seed, batch):
    rng = random.Random(seed)
    base = [rng.getrandbits(256) for _ in range(n // 8)]
    rows = []
    for e in range(n):
        v = rng.choice(base)
        for b in rng.sample(range(256), rng.choice([0, 3, 12, 13, 20])):
            v ^= 1 << b
        rows.append((e, e // batch, f"s{rng.randrange(n * 2)}", f"{rng.randrange(n * 3):064x}", words(v)))
    return rows


@pytest.mark.parametrize("bits", [1, 5])
def test_parts_by_more_bits_and_compaction(spark, tmp_path, monkeypatch, bits):
    rows = random_rows(240, bits, 60)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    store = h.History(spark, str(tmp_path), bits=bits)
    for b in range(4):
        if b == 2:
            store.compact()
            assert list(store.parts) == [2]
        if b == 3:
            monkeypatch.setattr(h, "CAPACITY", 8)
            store.compact()
            assert store.bits > bits or bits == 5
            monkeypatch.undo()
        store.ingest(df.filter(f"batch_no = {b}"))
    assert {tuple(r) for r in store.refused().collect()} == brute(rows)
    again = h.History(spark, str(tmp_path))
    assert again.parts == store.parts and again.size == store.accepted().count() and again.bits == store.bits


def test_slices_of_a_batch(spark, monkeypatch):
    rows = random_rows(200, 9, 200)
    monkeypatch.setattr(h, "MOST_ROWS", 50)
    assert run(spark, rows) == brute(rows)


def test_a_chain_takes_rounds(spark):
    v, rows = 0, []
    for e in range(12):
        rows.append((e, 0, f"s{e}", None, words(v)))
        for b in range(20):
            v ^= 1 << (20 * e + b)
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 6


@pytest.mark.parametrize("most", [0, 1, 8])
def test_rounds_and_one_task_decide_alike(spark, monkeypatch, most):
    """Where keys met more lesser ones than are told, rounds take over; the rows are the same."""
    monkeypatch.setattr(h, "MOST_LESSER", most)
    monkeypatch.setattr(h.probe, "__defaults__", (most,))
    rows = random_rows(160, 5, 80)
    assert run(spark, rows) == brute(rows)


def test_a_small_batch_reads_row_groups_and_not_the_table(spark, tmp_path, monkeypatch):
    """Rows unpacked for one batch of two entries at two sizes of the history, in the part that it meets."""
    taken = []
    for n in (500, 2000):
        rng = random.Random(n)
        rows = [(e, 0, f"s{e}", None, words(rng.getrandbits(256))) for e in range(n)]
        store = h.History(spark, str(tmp_path / str(n)), bits=(n // 500).bit_length() - 1)
        store.ingest(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
        files = [f for c in store.parts.values() for f in c["files"]]
        taken.append(sum(len(r) for r in h.Stored(files).read(0)))
    assert taken[1] < 2 * taken[0]


def test_a_new_worker_reads_the_table(spark, tmp_path):
    """A Python worker that has done nothing else yet reads the chunks, as after a minute's rest or a failed task."""
    store = h.History(spark, str(tmp_path))
    store.ingest(spark.createDataFrame([(1, 0, "a", None, words(7), "x", "y", "z")], SCHEMA))
    code = f"from reelgrain.llm.history import Stored; print(len(Stored({store.parts[0]['files']!r}).read(0)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "1", done.stderr


def test_copies_for_many_parts_are_not_held_together():
    """Packing keys for the 16 parts around each takes a small part of what it yields."""

    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    n, rng = 20_000, np.random.default_rng(2)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(rng.bytes(32 * n))]).cast(pa.binary())
    keys = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), raw, pa.array(np.arange(n)), pa.array(np.zeros(n, bool))], names=["kind", "value", "vid", "many"])
    run, total, rows = h.spread(Caught(), 5, False), 0, 0
    tracemalloc.start()
    for batch in run(iter([keys])):
        total += batch.nbytes
        rows += sum(len(h.Rows.unpack(b.as_py())) for b in batch.column(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * h.CHUNKS * 16 and peak < total / 2


def test_tasks_grow_with_the_parts_around_a_key(spark):
    keys = spark.createDataFrame([], "kind int, value binary, vid bigint, many boolean")
    tasks = [h.probe(keys, bits, [], True, 24).rdd.getNumPartitions() for bits in (0, 2, 4, 5)]
    assert tasks == [11, 16, 48, 64]


def test_a_part_is_read_without_its_neighbours(spark, tmp_path):
    """A part of a table in 64 buckets takes a small part of a chunk file, not row groups that hold many parts."""
    rng = random.Random(8)
    store = h.History(spark, str(tmp_path), bits=6)
    store.ingest(spark.createDataFrame([(e, 0, f"s{e}", None, words(rng.getrandbits(256))) + ("x", "y", "z") for e in range(6000)], SCHEMA))
    for _, ranges in h.Stored(store.parts[0]["files"]).files:
        assert max(sum(low <= part <= high for low, high in ranges) for part in range(64 * h.SLOTS)) <= len(ranges) / 2


def test_a_lost_chunk_file_is_an_error(spark, tmp_path):
    store = h.History(spark, str(tmp_path))
    store.ingest(spark.createDataFrame([(1, 0, "a", None, words(7), "x", "y", "z")], SCHEMA))
    for f in store.parts[0]["files"]:
        import os

        os.remove(f.removeprefix("file://"))
    with pytest.raises(Exception, match="(?i)no such file|FileNotFound"):
        store.ingest(spark.createDataFrame([(2, 1, "a", None, words(7), "x", "y", "z")], SCHEMA))


def test_hot_copies_stay_linear(spark):
    rng = random.Random(1)
    base = rng.getrandbits(256)
    rows = [(e, e // 1500, f"s{e}", None, words(base ^ (1 << rng.randrange(256)))) for e in range(3000)]
    got = run(spark, rows)
    assert got == {(0, e, "near") for e in range(1, 3000)}
    rows = [(e, 0, "same" if e % 3 else f"s{e}", f"{7:064x}" if e % 2 else None, None) for e in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_batch_by_batch_reads_the_store(spark):
    df = table(spark, "/root/testdata/sf0.001", "manifest")
    store = h.History(spark)
    step = set()
    for b in range(4):
        step |= {tuple(r) for r in store.ingest(df.filter(f"batch_no = {b}") if b < 3 else df.filter("batch_no >= 3")).collect()}
    rows = [(r.entry_id, r.batch_no, r.sample_id, r.video_sha256, r.frame_hashes) for r in df.collect()]
    assert step == brute(rows) == {tuple(r) for r in store.refused().collect()} and len(store.parts) == 4
    again = {r.refused_id for r in store.ingest(df.filter("batch_no = 1").withColumn("entry_id", df.entry_id + 10_000_000)).collect()}
    assert len(again) >= 0.9 * df.filter("batch_no = 1").count()
    store.drop()


def test_empty(spark):
    assert run(spark, []) == set() and run(spark, [(None, None, None, None, None)]) == set()
    assert run(spark, [(1, None, None, None, None), (2, None, None, None, None)]) == set()
    with pytest.raises(ValueError):
        h.History(spark, radius=25)


def test_a_second_history_reads_the_folder(spark, tmp_path):
    df = table(spark, "/root/testdata/sf0.001", "manifest")
    whole = brute([(r.entry_id, r.batch_no, r.sample_id, r.video_sha256, r.frame_hashes) for r in df.collect()])
    first = df.filter("batch_no <= 1")
    h.History(spark, str(tmp_path), bits=3).ingest(first)
    (tmp_path / "entries/1").mkdir()  # left by a part that was not committed
    store = h.History(spark, str(tmp_path))
    assert store.bits == 3 and len(store.parts) == 1
    assert store.ingest(first).isEmpty() and len(store.parts) == 1  # decided already
    store.ingest(df.filter("batch_no > 1"))
    assert {tuple(r) for r in h.History(spark, str(tmp_path)).refused().collect()} == whole
    with pytest.raises(ValueError):
        h.History(spark, str(tmp_path), bits=4)


def test_every_batch_is_appended(spark, monkeypatch):
    rows = [(e, e // 10, f"s{e % 25}", None, None) for e in range(40)]
    stored, store = [], h.History._store
    monkeypatch.setattr(h.History, "_store", lambda self, k, turn, taken: (stored.append(taken.count()), store(self, k, turn, taken))[1])
    assert run(spark, rows) == brute(rows) and stored == [10, 10, 5, 0]


def test_content_chunks_cover_a_value():
    value = random.Random(4).randbytes(32)
    chunks = h.content_chunks(value)
    assert b"".join(chunks) == value and 1 < len(chunks) < 32 and h.content_chunks(b"") == []


def test_a_probe_meets_the_near_keys_and_few_others():
    """Of a quarter of a million rows a key meets all that are within two bits of it, and on average under ten besides."""
    rng, n = np.random.default_rng(8), 1 << 18
    rows = h.Rows(np.arange(n), rng.integers(0, 1 << 24, n, dtype=np.uint32), np.zeros((n, 4), np.uint64), np.zeros(n, bool))
    index, keys = h.Index(rows, 24), rng.integers(0, 1 << 24, 500, dtype=np.uint32)
    for flips in range(h.FLIPS + 1):
        met = {(int(q), int(i)) for at, first, end in index.runs(index.cells(keys), flips) for q, a, b in zip(at, first, end) for i in index.rows.ids[a:b]}
        near = {(int(q), int(i)) for q, k in enumerate(keys) for i in np.flatnonzero(np.bitwise_count(rows.keys ^ k) <= flips)}
        assert near <= met and len(met - near) < 10 * len(keys)


def test_runs_of_small_and_crowded_parts():
    """Cells with many rows, and parts of one row: each row within the flips is met once."""
    rng = np.random.default_rng(9)
    for n, width, top in ((1, 12, 1 << 12), (300, 12, 40), (5000, 14, 1 << 14)):
        rows = h.Rows(np.arange(n), rng.integers(0, top, n, dtype=np.uint32), np.zeros((n, 4), np.uint64), np.zeros(n, bool))
        index, keys = h.Index(rows, width), rng.integers(0, top, 50, dtype=np.uint32)
        cells, own = index.cells(index.rows.keys), index.cells(keys)
        for flips in range(h.FLIPS + 1):
            met = [(int(q), i) for at, first, end in index.runs(own, flips) for q, a, b in zip(at, first, end) for i in range(a, b)]
            assert len(met) == len(set(met)) and set(met) == {(q, int(i)) for q, c in enumerate(own) for i in np.flatnonzero(np.bitwise_count(cells ^ c) <= flips)}


def test_bits_spread_so_that_only_a_late_chunk_shows_them(spark):
    """24 bits with three in each of seven chunks and one in another are met; with two in both others they are 25."""
    rng, rows, want = np.random.default_rng(10), [], set()
    for k in range(40):
        base = rng.integers(0, 2, 256, dtype=np.uint8)
        last = [(1, 2), (2, 1), (3, 0), (0, 3), (2, 2)][k % 5]
        other = base.copy()
        for c, many in enumerate([3] * 7 + list(last)):
            other[c :: h.CHUNKS][rng.choice(28, many, replace=False)] ^= 1
        for i, bits in enumerate((base, other)):
            rows.append((100 * i + k, i, None, None, [np.packbits(bits).tobytes().hex()[j : j + 16] for j in range(0, 64, 16)]))
        if sum(last) == 3:
            want.add((k, 100 + k, "near"))
    assert 21 + 4 > h.RADIUS and sum(f + 1 for f in h.FLIPPED) > h.RADIUS and run(spark, rows) == want


def test_many_small_batches_are_taken_together(spark, monkeypatch):
    """A hundred batches of two rows: not a pass over the history for each of them, and the refusals of one batch."""
    rng, rows = np.random.default_rng(11), []
    for e in range(200):
        rows.append((e, e // 2, f"s{e if e % 7 else max(0, e - 30)}", None, [rng.bytes(8).hex() for _ in range(4)] if e % 5 else rows[e // 2][4] if e else None))
    taken, ingest = [], h.History.ingest
    monkeypatch.setattr(h.History, "ingest", lambda self, batch: (taken.append(batch.count()), ingest(self, batch))[1])
    monkeypatch.setattr(h, "MOST_ROWS", 20)
    monkeypatch.setattr(h, "TOGETHER", 1, raising=False)
    got = run(spark, rows)
    assert sum(taken) == 200 and 5 < len(taken) < 30 and max(taken) <= 20
    assert got and got == run(spark, [(e, 0, *rest) for e, _, *rest in rows])
