import math

from reelgrain.operators.profile import NUMERIC, LoadProfile, column_profile, load_findings

LEAVES = "record_id bigint, run_id bigint, load_no int, value string, c string, identity struct<video_sha256: string, video_name: string>, media struct<duration_seconds: double, width: bigint, height: bigint, frame_rate: double, frame_count: bigint>, frame_summary struct<sampled_frame_count: bigint, mean_brightness: double, mean_contrast: double, mean_sharpness: double, dark_frame_ratio: double, white_frame_ratio: double>"


def row(i, load, sharp, name="a.mp4", run=1):
    return (i, run, load, "x", "y", ("0" * 64, name), (1.0, 10, 10, 25.0, 5), (8, 1.0, 1.0, sharp, 0.0, 0.0))


def findings(spark, rows, stated=None):
    df = spark.createDataFrame(rows, LEAVES)
    summary = spark.createDataFrame([(r, n, m) for (r, n), m in (stated or {}).items()], "run_id bigint, load_no int, missing_value_count_per_feature map<string,bigint>")
    schema = spark.createDataFrame([("0.10.0", "frame_summary.mean_sharpness", 0.0, 100.0), ("0.9.0", "media.width", 0.0, 1.0)], "feature_schema_version string, export_name string, minimum double, maximum double")
    return {(r.run_id, r.load_no, r.column_name, r.finding) for r in load_findings(df, summary, schema).collect()}


def test_each_finding(spark):
    sharp = "frame_summary.mean_sharpness"
    rows = [row(i, 1, 10.0) for i in range(10)] + [row(100 + i, 3, 10.0 if i < 6 else 50.0) for i in range(10)]
    assert findings(spark, rows) == {(1, 3, sharp, "shift")}
    assert findings(spark, rows[:10] + [row(100 + i, 2, 10.0 if i < 7 else 50.0) for i in range(10)]) == set()  # exactly 0.3 is no shift
    assert findings(spark, [row(1, 1, 101.0)]) == {(1, 1, sharp, "range")}
    assert findings(spark, [row(1, 1, math.nan), row(2, 2, None), row(3, 2, 5.0)]) == {(1, 2, sharp, "null_rate")}
    assert findings(spark, [row(1, 1, math.nan), row(2, 1, None)], {(1, 1): {sharp: 2}}) == set()
    assert findings(spark, [row(1, 1, math.nan)], {(1, 1): None}) == {(1, 1, sharp, "missing_count")}
    assert findings(spark, [row(1, 1, 1.0, n) for n in [".mp4"]]) == {(1, 1, "identity.video_name", "pattern")}


def test_repeats_count_once_and_empty(spark):
    rows = [row(1, 1, 10.0)] * 5 + [row(2, 1, 50.0)]
    p = LoadProfile(spark.createDataFrame(rows, LEAVES))
    out = {r.column_name: r for r in p.by_load().collect()}
    assert out["frame_summary.mean_sharpness"].n == 2 and len(out) == len(NUMERIC) + 2
    assert findings(spark, []) == set()


def test_outliers_do_not_hide_a_shift(spark):
    rows = [row(i, 1, 1.0 + i * 1e-6) for i in range(50)] + [row(100, 1, 1e12)] + [row(200 + i, 2, 2.0 + i * 1e-6) for i in range(50)]
    got = findings(spark, rows)
    assert (1, 2, "frame_summary.mean_sharpness", "shift") in got


def test_every_leaf_is_profiled(spark):
    rows = [row(i, 1, s) for i, s in enumerate((1.0, 3.0, math.inf, math.nan))] + [row(9, 2, 5.0, "a/b.mp4")]
    schema = spark.createDataFrame([("0.10.0", "frame_summary.mean_sharpness", 0.0, 2.0)], "feature_schema_version string, export_name string, minimum double, maximum double")
    out = {(r.load_no, r.column_name): r for r in column_profile(spark.createDataFrame(rows, LEAVES), schema).collect()}
    assert len(out) == 2 * (len(NUMERIC) + 2)
    sharp = out[1, "frame_summary.mean_sharpness"]
    assert (sharp.missing, sharp.distinct_values, sharp.violations, sharp.summed, sharp.mean, sharp.deviation) == (1, 3, 2, 2, 2.0, 1.0)
    name = out[2, "identity.video_name"]
    assert (name.violations, name.distinct_values, name.missing, name.mean) == (1, 1, 0, None)
