import hashlib
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrain.functions import scalars as sc
from reelgrain.operators import audit, signals
from reelgrain.operators import validation as va
from reelgrain.sources import files, sinks


def wav(path, amplitudes, rate=1000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(amplitudes.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((amplitudes * 32767).round().astype("<i2").tobytes())


def test_audio(spark, tmp_path):
    """A square wave, two unlike ramps and a burst between pauses: their figures follow from the samples as written."""
    rate, ramp = 800, np.linspace(-0.6, 0.6, 601)
    square = np.where(np.arange(640) % 16 < 8, 0.25, -0.25)
    burst = np.concatenate([np.zeros(300), np.tile([0.75, -0.75, 0.0, 0.004], 25), np.full(100, 0.002)])
    signal = {"square.wav": square[:, None], "ramps.wav": np.stack([ramp, ramp[::-1] / 3], 1), "burst.wav": burst[:, None]}
    for name, x in signal.items():
        wav(tmp_path / name, x, rate)
    s = files.pcm_samples(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in signals.audio_metrics(s, silence=0.003, clip=0.7).collect()}
    for name, x in signal.items():
        held = (x * 32767).round() / 32768
        mono = held.mean(axis=1)
        r = got[name]
        assert (r.rms, r.peak, r.mean) == pytest.approx(((held**2).mean() ** 0.5, np.abs(held).max(), held.mean()), abs=1e-12)
        assert (r.clipping_ratio, r.silence_ratio) == pytest.approx(((np.abs(held) >= 0.7).mean(), (np.abs(mono) <= 0.003).mean()))
        assert r.zero_crossing_rate == pytest.approx(np.mean((mono[1:] < 0) != (mono[:-1] < 0)))
        levels = (held**2).mean(axis=0) ** 0.5
        assert r.channel_imbalance == pytest.approx(levels.max() - levels.min()) and [c.rms for c in r.channels] == pytest.approx(levels.tolist())
    one = s.filter(F.col("path").endswith("square.wav")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "amplitude"))), lambda x: x["amplitude"]).alias("x"))
    spectrum = np.abs(np.fft.rfft((square * 32767).round() / 32768))
    want = (spectrum * np.fft.rfftfreq(640, 1 / rate)).sum() / spectrum.sum()
    assert one.select(signals.spectral_centroid("x", F.lit(float(rate))).alias("c")).first().c == pytest.approx(want)


def test_frames(spark):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (32, 48), dtype=np.uint8)
    rows = [(1, bytes(32 * 48), 48, 32), (2, bytes([255]) * (32 * 48), 48, 32), (3, noise.tobytes(), 48, 32)]
    df = spark.createDataFrame(rows, "i int, gray binary, width int, height int")
    got = {r.i: r.m for r in df.select("i", signals.frame_metrics("gray", "width", "height").alias("m")).collect()}
    assert got[1].dark_pixel_ratio == 1 and got[2].bright_pixel_ratio == 1 and got[1].laplacian_variance == 0
    assert got[3].brightness_mean == pytest.approx(noise.mean()) and len(got[3].perceptual_hash) == 16
    pair = df.filter("i = 3").select(signals.histogram_correlation("gray", "gray").alias("c")).first().c
    assert pair == pytest.approx(1)


def test_probe(spark):
    stream = {"codec_type": "video", "index": 1, "duration": "2.0", "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "width": 1920, "height": 1080, "tags": {"rotate": "90"}}
    picture = {"codec_type": "video", "index": 0, "disposition": {"attached_pic": 1}}
    bodies = [(1, json.dumps({"format": {"duration": "2.5"}, "streams": [picture, stream]})), (2, json.dumps({"streams": []})), (3, None), (4, "broken")]
    got = {r.k: r for r in files.probe_metadata(spark.createDataFrame(bodies, "k int, b string"), "k", "b").collect()}
    assert (got[1].video_index, got[1].frame_rate, got[1].frame_count, got[1].display_width, got[1].display_height, got[1].audio_present) == (1, 29.97003, 60, 1080, 1920, False)
    assert not got[1].unusual_rate and got[2].video_index is None and got[3].unusual_rate and len(got) == 4


def test_listing_and_exports(spark, tmp_path):
    for name in ("B.MP4", "a.mov", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 2048)
    assert {r.name: r.size for r in files.media_files(spark, str(tmp_path)).collect()} == {"B.MP4": "2.00 KiB", "a.mov": "2.00 KiB"}
    assert files.content_digests(spark, str(tmp_path), "*.txt").first().sha256 == hashlib.sha256(b"x" * 2048).hexdigest()
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('a;b\n1;"x;y"\nNaN; \n', encoding="utf-8")
    rows = files.feature_csv(spark, path).collect()
    assert [tuple(r) for r in rows] == [("1", "x;y"), (None, None)]
    (tmp_path / "m.jsonl").write_text('{"sample_id": "s"}\n\nbroken\n{"sample_id": "t"}\n')
    good, bad = files.manifest_jsonl(spark, str(tmp_path / "m.jsonl"), "sample_id string")
    assert sorted(r.sample_id for r in good.collect()) == ["s", "t"] and [r.line for r in bad.collect()] == ["broken"]
    with pytest.raises(ValueError):
        files.feature_table(spark, "x.docx")
    df = spark.createDataFrame([(2, math.nan, None), (1, 1.5, "é")], "id int, v double, s string")
    sinks.export_jsonl(df, str(tmp_path / "o.jsonl"), "id")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "o.jsonl").glob("part-*"))).splitlines()
    assert lines == ['{"id":1,"s":"é","v":1.5}', '{"id":2,"s":null,"v":null}']
    sinks.export_csv(df.drop("v"), str(tmp_path / "o.csv"), "id")
    assert "".join(p.read_text() for p in sorted((tmp_path / "o.csv").glob("part-*"))).splitlines()[:2] == ["id,s", "1,é"]


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in ("12.0", "1e3", "12.5", "nan", "inf", "1d", "abc", "x1", " 7 ", None, "")], "x string")
    got = [(r.k, r.w) for r in df.select(sc.number_kind(F.col("x")).alias("k"), sc.whole_number(F.col("x")).alias("w")).collect()]
    assert got == [("numeric", 12), ("numeric", 1000), ("numeric", None), ("missing", None), ("invalid_numeric", None), ("invalid_numeric", None), ("not_numeric", None), ("invalid_numeric", None), ("numeric", 7), ("missing", None), ("missing", None)]
    row = spark.range(1).select(
        sc.region(F.lit("region-r02-c03")).alias("r"), sc.neighbours(sc.region(F.lit("region-r00-c00")), sc.region(F.lit("region-r01-c01"))).alias("n"), sc.truth(F.lit(" TRUE")).alias("t"),
        sc.safe_name(F.lit("..__")).alias("s"), sc.capped_metrics(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(None).cast("int")), 1).alias("m"), sc.frame_rate(F.lit("0/0")).alias("f"),
    ).first()
    assert tuple(row.r) == (2, 3) and row.n and row.t and row.s == "video" and row.m == {"b": 1} and row.f is None


def test_constraints(spark):
    df = spark.createDataFrame([(1, "/abs", 1.5), (2, "a/../b", 0.5), (3, None, None)], "k int, p string, r double")
    got = {(r.k, r.rule) for r in va.violations(df, ["k"], {"path": va.unsafe_path(F.col("p")), "ratio": ~F.col("r").between(0, 1)}).collect()}
    assert got == {(1, "path"), (1, "ratio"), (2, "path")}
    nested = spark.createDataFrame([], "a struct<Verdict: int, b: array<struct<threshold: int>>>, c map<string, struct<ok: int>>").schema
    assert va.forbidden_fields(nested) == ["a.Verdict", "a.b.threshold"]
    assert va.topological({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    assert va.fingerprint({"a": 1, "generated_at": 2}) == va.fingerprint({"generated_at": 3, "a": 1})
    p = spark.createDataFrame([(0.0,), (1.96,), (None,)], "z double").select(audit.two_sided_p("z").alias("p")).collect()
    assert p[0].p == 1 and p[1].p == pytest.approx(0.05, abs=1e-3) and p[2].p is None


def test_regions(spark):
    t = spark.createDataFrame([(1, 0.2), (2, 0.4)], "t int, x double")
    cells = signals.across_grid(t)
    assert cells.count() == 32
    s = signals.regional_summary(cells.withColumn("e", F.col("x") * (F.col("row") + 1)), "t", ("e",)).filter("t = 1").first()
    assert s.regions == 16 and s.max_e == pytest.approx(0.8) and s.concentration_e == pytest.approx(0.3)


def test_pair_and_region_kernels(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 200, (32, 48), dtype=np.uint8)
    b = a.copy()
    b[:8, :12] = 255 - b[:8, :12]
    df = spark.createDataFrame([(7, 0, 1, a.tobytes(), b.tobytes(), 48, 32)], "entity bigint, from_index int, to_index int, before binary, after binary, width int, height int")
    m = df.select(signals.pair_metrics("before", "after", "width", "height").alias("m")).first().m
    assert m.mean_absolute_difference == pytest.approx(np.abs(a.astype(float) - b).mean() / 255) and m.brightness_difference == pytest.approx(abs(a.mean() - b.mean())) and 0 <= m.hash_distance <= 64
    rows = {r.region_id: r for r in signals.classified_regions(signals.region_metrics(df), edge=0.2, texture=0.05, detail=0.9, brightness=0.05).collect()}
    assert len(rows) == 16 and [k for k, r in rows.items() if r.varies] == ["region-r00-c00"]
    r = rows["region-r00-c00"]
    assert r.brightness_difference == pytest.approx(abs(a[:8, :12].mean() - b[:8, :12].mean()) / 255) and r.triggered_rules[-1] == "brightness_difference"
    assert rows["region-r03-c03"].edge_instability == 0 and rows["region-r03-c03"].texture_distance == pytest.approx(0)
    colour = spark.createDataFrame([(bytes([10, 20, 30, 30, 40, 50]),)], "raw binary").select(signals.mean_colour("raw").alias("c")).first().c
    assert tuple(colour) == (20, 30, 40)


def test_detectors(spark):
    from reelgrain.operators import detectors as dt

    on = {"enabled": True, "preprocessing_mode": "upstream_compatible", "encoder": "mean_pool", "distance_mode": "l2"}
    reasons = [dt.available(on | x).reason_code for x in ({"detectors_enabled": False}, {"enabled": False}, {"preprocessing_mode": "x"}, {"encoder": "x"}, {"distance_mode": "x"}, {})]
    assert reasons == ["global_detector_layer_disabled", "detector_disabled", "unsupported_preprocessing_mode", "invalid_encoder", "invalid_distance_mode", None]
    needs = dt.available(on | {"encoder": "big"}, {"big": dt.Encoder("big", ("no_such_package",), dt.mean_pool)})
    assert (needs.reason_code, needs.missing) == ("optional_dependencies_missing", ("no_such_package",))
    rows = [("a", i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (3, 4), (6, 8), (6, 10)])] + [("b", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "entity string, frame_index int, vector array<double>")
    got = {r.entity: r for r in dt.run(df, dt.SecondOrder, on).collect()}
    assert got["a"].status == "completed" and got["a"].score == pytest.approx(np.std([0, -3], ddof=1)) and got["a"].frames == 4
    assert (got["b"].status, got["b"].reason_code, got["b"].message) == ("failed", "analysis_failed", "fewer than three frames")
    assert {r.status for r in dt.run(df, dt.SecondOrder, on | {"enabled": False}).collect()} == {"disabled"}

    class Slow(dt.SecondOrder):
        def analyse(self, vectors):
            import time

            time.sleep(5)
            return 0.0

    assert {r.reason_code for r in dt.run(df.filter("entity = 'a'"), lambda: Slow(), on, limit_seconds=0.2).collect()} == {"worker_timeout"}
    gray = np.arange(64, dtype=np.uint8).reshape(8, 8)
    frames = spark.createDataFrame([("a", 0, gray.tobytes(), 8, 8)], "entity string, frame_index int, raw binary, width int, height int")
    assert dt.encoded_frames(frames).first().vector == [float(x) for x in range(64)]
    out = dt.prepared(np.full((40, 100, 3), 128.0), 16)
    assert out.shape == (3, 16, 16) and out[0, 3, 3] == pytest.approx((128 / 255 - 0.485) / 0.229)
    wide = np.repeat(np.arange(100.0)[None, :, None], 10, 0).repeat(3, 2)
    assert dt.prepared(wide, 80, mean=(0, 0, 0), deviation=(1, 1, 1))[0, 0, [0, -1]] * 255 == pytest.approx([10, 89])


def test_settings(spark, monkeypatch):
    from reelgrain import config

    s = config.Settings.read({"REELGRAIN_MOST_SAMPLES": "10", "REELGRAIN_COMPACT_ENABLED": "off", "REELGRAIN_COMPACT_EVENTS": "-3", "REELGRAIN_MISSING_SHARE": "0.5", "REELGRAIN_CORRELATION": "inf", "REELGRAIN_GRID_ROWS": "x"})
    assert (s.most_samples, s.compact_enabled, s.compact_events, s.missing_share, s.correlation, s.grid_rows) == (10, False, 5, 0.5, 0.95, 4)
    assert config.env_file("# note\nexport A = 'b c'\nBAD\nC=d=e\n") == {"A": "b c", "C": "d=e"} and json.loads(s.document())["most_samples"] == 10
    assert {r.name: r.version for r in config.environment(spark, ("numpy", "no_such_package")).collect()}["no_such_package"] is None


def test_output_sets(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, s string")
    root = str(tmp_path / "set")
    paths = sinks.output_set(spark, root, {"rows": (df, "csv"), "nested": (df, "json")}, {"profile": {"n": 2}})
    assert [p.rsplit("/", 1)[1] for p in paths] == ["rows.csv", "nested.json", "profile.json"] and json.loads((tmp_path / "set/profile.json").read_text()) == {"n": 2}
    with pytest.raises(FileExistsError):
        sinks.output_set(spark, root, {"other": (df, "csv")}, {"profile": {}})
    assert not (tmp_path / "set/other.csv").exists()
    sinks.output_set(spark, root, {"rows": (df.limit(1), "csv")}, {"profile": {"n": 1}}, overwrite=True)
    with pytest.raises(ValueError):
        sinks.output_set(spark, root, {"fresh": (df, "csv")}, {"bad": {"x": math.nan}})
    assert not (tmp_path / "set/fresh.csv").exists()
    parts = sinks.written_parts(spark, f"{root}/nested.json").collect()
    assert parts and all(r.sha256 == hashlib.sha256(open(r.path.removeprefix("file:"), "rb").read()).hexdigest() for r in parts)
    assert sinks.new_folder(spark, str(tmp_path), "run").endswith("_run")
    (tmp_path / "a b.mp4").write_bytes(b"abc")
    plan = spark.createDataFrame([(str(tmp_path / "a b.mp4"), "real", "f" * 64, "a b.mp4")], "source string, label string, digest string, name string")
    first, again = (sinks.copied(spark, plan, str(tmp_path / "pilot")).first() for _ in range(2))
    assert first.target.endswith("pilot/real/ffffffffffffffff__a_b.mp4") and not first.existing and again.existing and again.size_bytes == 3


def test_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('name;note\nAndré;"two\nlines"\nx;y\n'.encode("latin-1"))
    assert [tuple(r) for r in files.feature_csv(spark, str(tmp_path / "q.csv")).collect()] == [("André", "two\nlines"), ("x", "y")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):
        files.feature_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.feature_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "one.json").write_text('{\n "identity": {"a": 1}\n}')
    assert files.json_documents(spark, str(tmp_path / "one.json")).first().identity.a == 1
    (tmp_path / "two.json").write_text("[1]")
    with pytest.raises(ValueError, match="no object"):
        files.json_documents(spark, str(tmp_path / "two.json"))
    (tmp_path / "exports").mkdir()
    (tmp_path / "exports/features.jsonl").write_text('{"a": 1}\n')
    assert files.resolved(spark, None, [str(tmp_path / "exports/features.csv"), str(tmp_path / "exports/features.jsonl")]).endswith(".jsonl")
    with pytest.raises(FileNotFoundError):
        files.resolved(spark, str(tmp_path / "gone.csv"), [])
    (tmp_path / "probe").mkdir()
    (tmp_path / "probe/a.json").write_text('{"format": {"duration": "2"}, "streams": []}')
    (tmp_path / "probe/b.json").write_text("broken")
    got = {r.path.rsplit("/", 1)[1]: (r.error is None) for r in files.probe_documents(spark, str(tmp_path / "probe")).collect()}
    assert got == {"a.json": True, "b.json": False}
    big = tmp_path / "big"
    big.mkdir()
    (big / "x.bin").write_bytes(bytes(range(256)) * 5000)
    assert files.streamed_digests(spark, str(big), chunk=1000).first().sha256 == hashlib.sha256(bytes(range(256)) * 5000).hexdigest()


def test_more_scalars(spark):
    row = spark.range(1).select(
        sc.human_duration(F.lit(2)).alias("d"), sc.human_bit_rate(F.lit(2_500_000)).alias("b"), sc.human_bit_rate(F.lit(999)).alias("c"), sc.container_family(F.lit("mov, mp4,3gp")).alias("f"), sc.container_family(F.lit("ogg")).alias("o"), sc.codec_level(F.lit(41)).alias("l"), sc.codec_level(F.lit(5)).alias("m"),
        sc.orientation(F.lit(3), F.lit(4)).alias("p"), sc.display_size(F.lit(1920), F.lit(1080), F.lit(270)).alias("s"), sc.short_message(F.lit(" a\n  b "), 3).alias("t"), sc.is_version(F.lit("0.10.0")).alias("v"), sc.is_version(F.lit("v1.0")).alias("w"), sc.sample_name(F.lit("real"), F.lit("ab" * 32)).alias("n"),
        sc.half_even(F.lit(0.125), 2).alias("h"), sc.half_even(F.lit(2.5), 0).alias("e"), sc.change_ratio(F.lit(0.1), F.lit(0.4)).alias("r"), sc.human_size(F.lit(1023)).alias("z"),
        sc.stream_rotation(F.lit(None).cast("string"), F.array(F.struct(F.lit(None).cast("string").alias("rotation"), F.lit("-90.2").alias("displaymatrix_rotation")))).alias("q"),
    ).first()
    assert (row.d, row.b, row.c, row.f, row.o, row.l, row.m, row.p, tuple(row.s), row.t, row.v, row.w) == ("2.00 seconds", "2.50 Mbps", "999 bps", "MP4/MOV family", "ogg", "4.1", "5", "portrait", (1080, 1920), "a b", True, False)
    assert (row.n, row.h, row.e, row.z, row.q) == ("real-" + "ab" * 8, 0.12, 2.0, "1023 B", 270) and tuple(row.r) == pytest.approx((4.0, 0.25))


def test_planted_paths_and_references(spark, tmp_path):
    """The queries of FLT-11 and JON-11 over tables that hold what they look for."""
    from reelgrain.plans import datasets

    base = {"batch_no": 0, "video_sha256": "a" * 64, "expected_label": "real", "feature_schema_version": "1", "application_version": "1", "source": None, "generator_or_camera": None, "notes": None, "added_at": None}
    entries = [(1, "s1", "ok.mp4", "f/1.json"), (2, "s2", "/abs.mp4", "f/2.json"), (3, "s3", "x.mp4", "a/../b.json"), (4, "s4", "C:/x.mp4", None), (5, "s5", "a..b.mp4", "f/5.json")]
    spark.createDataFrame([{**base, "entry_id": e, "sample_id": s, "video_name": v, "feature_file": f} for e, s, v, f in entries], "entry_id bigint, batch_no int, sample_id string, video_name string, video_sha256 string, expected_label string, feature_schema_version string, application_version string, feature_file string, source string, generator_or_camera string, notes string, added_at string").write.parquet(str(tmp_path / "manifest.parquet"))
    records = [(1, "s1", ("a" * 64,)), (2, "s2", ("b" * 64,)), (3, "gone", (None,))]
    spark.createDataFrame(records, "record_id bigint, sample_id string, identity struct<video_sha256: string>").write.parquet(str(tmp_path / "outcome_features.parquet"))
    assert {r.entry_id for r in datasets.QUERIES["flt11_unsafe_paths"](spark, str(tmp_path)).collect()} == {2, 3, 4}
    assert {tuple(r) for r in datasets.QUERIES["jon11_references"](spark, str(tmp_path)).collect()} == {("s2", "digest_differs", 1), ("gone", "missing", 1)}
