from reelgrain.operators.rejects import loaded, rejected

HEADER = "path,label,method,compression,frames,width,height,codec"


def run(spark, lines, header=HEADER):
    rows = [(0, "f", 1, header, "x", "y")] + [(i + 1, "f", i + 2, line, "x", "y") for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "raw_id bigint, file_name string, line_no int, raw_line string, label string, names string")
    labels = spark.createDataFrame([("real", "real"), ("fake", "ai_generated")], "alias string, expected_label string")
    return {r.raw_id: r.reason for r in rejected(df, labels).collect()}, {r.raw_id: r for r in loaded(df, labels).collect()}


def test_reasons_in_order(spark):
    bad, good = run(spark, [
        'a.mp4, REAL ,m,c,1,"2",3,h264\r', '"a ""b"", c.mp4",fake,,,,,,', 'a"b.mp4,nope,m,c,1,2,3,h', '"a"z,real,m,c,1,2,3,h', "a.mp4,real", "a.mp4,nope,m,c,x,2,3,h",
        "/a.mp4,real,m,c,x,2,3,h", "a/../b.mp4,real,m,c,1,2,3,h", "C:a.mp4,real,m,c,1,2,3,h", " ,real,m,c,1,2,3,h", "a..b.mp4,real,m,c,1,2,1.5,h", "", None, "a.mp4,real,m,c,1,2,3,h,",
    ])
    assert bad == {3: "quoting", 4: "quoting", 5: "column_count", 6: "label", 7: "path", 8: "path", 9: "path", 10: "path", 11: "number", 12: "column_count", 13: "column_count", 14: "column_count"}
    assert (good[1].path, good[1].expected_label, good[1].frames, good[1].width, good[1].codec) == ("a.mp4", "real", 1, 2, "h264")
    assert good[2].path == 'a "b", c.mp4' and good[2].frames is None and set(good) == {1, 2}


def test_semicolons_mark_and_no_header(spark):
    bad, good = run(spark, ["real;x/y.mp4;7", "real;x,y.mp4;"], header='﻿"label";path;frames\r')
    assert bad == {} and good[1].frames == 7 and good[2].path == "x,y.mp4"
    df = spark.createDataFrame([(1, "g", 2, "a,b"), (2, "g", 3, 'x"')], "raw_id bigint, file_name string, line_no int, raw_line string")
    labels = spark.createDataFrame([], "alias string, expected_label string")
    assert {r.raw_id: r.reason for r in rejected(df, labels).collect()} == {1: "column_count", 2: "quoting"}


def test_very_long_fields_do_not_overflow(spark):
    line = '"' + '""' * 50_000 + 'x.mp4",real,m,c,1,2,3,h'
    bad, good = run(spark, [line, '"' + "a" * 500_000, "," * 100_000])
    assert bad == {2: "quoting", 3: "column_count"} and len(good[1].path) == 50_005


def test_valid_lines_name_what_fits_no_type(spark):
    bad, good = run(spark, ["a.mp4,real,m,c,99999999999999999999,2,3,h,1.5", "b.mp4,real,m,c,1,2,3,h,big"], header=HEADER + ",file_size_mb")
    assert bad == {} and good[1].not_cast == ["frames"] and good[1].frames is None and good[1].file_size_mb == 1.5 and good[2].not_cast == ["file_size_mb"] and good[2].width == 2
