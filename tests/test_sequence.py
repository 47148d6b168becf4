import random

from pyspark.sql import functions as F

from reelgrain.operators import intervals as iv
from reelgrain.operators import sequence as sq
from reelgrain.streaming import streams as st

T = "entity bigint, from_index int, to_index int, start_seconds double, end_seconds double, difference double, flag boolean"


def moves(spark, flags, times):
    rows = [(1, i, i + 1, times[i], times[i + 1], 0.5, f) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, T)


def test_scene_cut(spark):
    df = moves(spark, [False, True, False], [0.0, 0.2, 0.4, 0.6])
    got = sorted((r.scene_index, r.start_seconds, r.end_seconds, r.sample_count) for r in sq.scenes(df, F.col("flag")).collect())
    assert got == [(0, 0.0, 0.4, 2), (1, 0.4, 0.6, 2)]
    where = {r.to_index: r.scene_index for r in sq.scene_of(df, sq.scenes(df, F.col("flag"))).collect()}
    assert where == {1: 0, 2: 0, 3: 0}  # a start on the shared edge belongs to the earlier scene
    last = sq.scenes(moves(spark, [False, True], [0.0, 0.2, 0.4]), F.col("flag")).orderBy("scene_index").collect()
    assert [(r.start_seconds, r.end_seconds, r.sample_count) for r in last] == [(0.0, 0.4, 2), (0.4, 0.4, 1)]


def test_still_run(spark):
    df = moves(spark, [False, True, True, True, False], [0.0, 0.2, 0.4, 0.6, 0.9, 1.1])
    got = sq.islands(df, F.col("flag"), 0.6).collect()
    assert [(r.start_seconds, r.end_seconds, r.transition_count) for r in got] == [(0.2, 0.9, 3)]
    assert sq.islands(df, F.col("flag"), 0.71).count() == 0 and sq.islands(df.limit(0), F.col("flag"), 0.1).count() == 0


def test_windows(spark):
    df = spark.createDataFrame([(1, i, i / 1000, 0.0) for i in range(2000)] + [(2, 0, 0.0, 1.0)], "entity bigint, sample_index int, seconds double, value double")
    got = sq.sliding(df, 500, 250).groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in got} == {1: 7, 2: 1}


def test_folds_carry_over_batches(spark):
    rng = random.Random(0)
    rows = [(e, i, i * 0.1 + e) for e in (1, 2) for i in range(25_000)]
    df = spark.createDataFrame(rows, "entity bigint, sample_index int, seconds double").repartition(3)
    got = sorted((r.entity, r.sample_index) for r in sq.thin(df, 1.0, 5000).collect())
    assert got == [(e, i) for e in (1, 2) for i in range(0, 25_000, 10)]
    assert sq.thin(df, 1.0, 3).count() == 6 and sq.thin(df.limit(0), 1.0, 3).count() == 0
    items = sorted((rng.uniform(0, 60), rng.uniform(0, 3), rng.randrange(4), rng.randrange(4), i) for i in range(300))
    frame = spark.createDataFrame([(1, s, s + n, r, c, i) for s, n, r, c, i in items], "entity bigint, start_seconds double, end_seconds double, row int, column int, id bigint")
    seeds, want = [], {}
    for s, n, r, c, i in sorted(items, key=lambda x: (x[0], x[0] + x[1], x[4])):
        for k, (s0, e0, r0, c0) in enumerate(seeds):
            if (min(s + n, e0) - max(s, s0)) / max(min(n, e0 - s0), 1e-9) >= 0.5 and abs(r - r0) <= 1 and abs(c - c0) <= 1:
                want[i] = k + 1
                break
        else:
            seeds.append((s, s + n, r, c))
            want[i] = len(seeds)
    assert {r.id: r.seed for r in sq.first_fit(frame).collect()} == want


def test_anchor_groups(spark):
    make = lambda spans: spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "entity bigint, id bigint, start_seconds double, end_seconds double")
    groups = lambda spans: [r.event for r in sq.merge_anchors(make(spans), 0.25, 1.25).orderBy("id").collect()]
    assert groups([(0.0, 0.2), (0.4, 0.5)]) == [1, 1]
    assert groups([(0.3 * i, 0.3 * i + 0.1) for i in range(5)]) == [1, 1, 1, 1, 2]
    assert groups([(0.8, 1.0), (2.8, 3.0)]) == [1, 2]


def test_times_fall_back(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, 4.0), (1, 200, -1.0)], "entity bigint, sample_index int, seconds double")
    got = [(r.seconds, r.source) for r in sq.monotone_times(df).orderBy("sample_index").collect()]
    assert got == [(0.0, "frame_number"), (5.0, "reported"), (5.0, "previous"), (8.0, "frame_number")]


def test_interval_joins_against_brute_force(spark):
    rng = random.Random(1)
    one, two = ([(rng.randrange(3), i, s := round(rng.uniform(0, 50), 3), round(s + rng.choice([0, 0.3, 2, 20]), 3)) for i in range(80)] for _ in range(2))
    ddl = "entity bigint, id bigint, start_seconds double, end_seconds double"
    a, b = spark.createDataFrame(one, ddl), spark.createDataFrame(two, ddl)
    got = sorted((r.entity, r.l_id, r.r_id) for r in iv.near_pairs(a, b, 0.25, 5.0).collect())
    want = sorted((e, i, j) for e, i, s, t in one for f, j, u, v in two if e == f and min(t, v) - max(s, u) >= -0.25)
    assert got == want
    left = {(r.entity, r.id) for r in iv.unmatched(a, b, 0.25, 5.0).collect()}
    assert left == {(e, i) for e, i, *_ in one} - {(e, i) for e, i, _ in want}
    assert sorted((r.entity, r.l_id, r.r_id) for r in iv.band_equal(a, b, 0.5).collect()) == sorted((e, i, j) for e, i, s, _ in one for f, j, u, _ in two if e == f and abs(s - u) <= 0.5 + 1e-9)


def test_ledger_files_follow_what_is_new(spark, tmp_path):
    """Batches with rows again, a null key and nothing: each key once, one file for a batch that adds rows and none for others."""
    path = str(tmp_path / "ledger")
    write = st.ledger(path, "k", 16)
    batches = [range(0), range(300), range(200, 500), range(500), [7], [900]]
    files = []
    for i, keys in enumerate(batches):
        write(spark.createDataFrame([(f"s{k}", i) for k in keys for _ in range(2)] + [(None, i)], "k string, batch_no int"), i)
        files.append(len(list((tmp_path / "ledger").rglob("*.parquet"))))
    got = {r.k: r.batch_no for r in spark.read.parquet(path).collect()}
    assert got == {f"s{k}": 1 if k < 300 else 2 for k in range(500)} | {"s900": 5} and spark.read.parquet(path).count() == 501
    assert files == [1, 2, 3, 3, 3, 4]
