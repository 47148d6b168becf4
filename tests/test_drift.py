import json

import pytest

from reelgrain.operators.drift import changes, current_names, uncast, unified, version_key

EVOLUTION = "id string, introduced_version string, aliases array<string>, renamed_from string, deprecated_version string, removed_version string"


@pytest.fixture(scope="module")
def evolution(spark):
    return spark.createDataFrame([("old", "0.1", [], None, None, None), ("mid", "0.1", ["m"], "old", None, None), ("new", "0.2", ["n"], "mid", None, None), ("gone", "0.1", None, None, "0.9.2", None)], EVOLUTION)


def frame(spark, files):
    rows = [(i, "p", k, p if p is None or isinstance(p, str) else json.dumps(p), "a", "b") for i, (k, p) in enumerate((k, p) for k, ps in files.items() for p in ps)]
    return spark.createDataFrame(rows, "record_id bigint, producer string, file_no int, payload string, name string, version string")


def test_names_follow_chains(evolution):
    names, deprecated = current_names(evolution)
    assert {names[k] for k in ("old", "m", "mid", "n", "new")} == {"new"} and deprecated == {"gone": "0.9.2"}
    assert version_key("v0.10.0") > version_key("0.9.4")


def test_changes(spark, evolution):
    v = "identity.feature_schema_version"
    files = {1: [{"old": 1, v: "0.9.1", "gone": True}, {"x": None}], 3: [{"mid": 1.0, v: "v0.9.2", "gone": None}], 4: [{"mid": 2, "n": 3, v: "0.10.0"}, None, "broken", "[1]"], 5: [None]}
    got = {(r.file_no, r.feature_id, r.change) for r in changes(frame(spark, files), evolution).collect()}
    assert got == {(3, "new", "renamed"), (3, "new", "retyped"), (3, "x", "removed"), (3, "gone", "deprecated"), (4, "new", "renamed"), (4, "new", "retyped"), (4, "gone", "removed"), (5, "new", "removed")}


def test_empty_and_repeated(spark, evolution):
    assert changes(frame(spark, {}), evolution).count() == 0
    once = {1: [{"a": 1}], 2: [{"a": "x"}]}
    twice = {k: v * 3 for k, v in once.items()}
    assert sorted(changes(frame(spark, once), evolution).collect()) == sorted(changes(frame(spark, twice), evolution).collect())


def test_unified_types(spark, evolution):
    schema = spark.createDataFrame([("0.9.4", "new", "string"), ("0.10.0", "new", "integer"), ("0.10.0", "flag", "boolean")], "feature_schema_version string, export_name string, data_type string")
    rows = {r.record_id: r for r in unified(frame(spark, {1: [{"old": "12.0", "flag": True, "sample_id": "s"}, {"n": 1.5}, {"new": 9007199254740993}, None]}), evolution, schema).collect()}
    assert (rows[0]["new"], rows[0]["flag"], rows[0]["sample_id"]) == (12, True, "s")
    assert rows[1]["new"] is None and rows[2]["new"] == 9007199254740993 and rows[3]["new"] is None


def test_values_that_do_not_fit_are_reported(spark, evolution):
    schema = spark.createDataFrame([("0.10.0", "new", "integer"), ("0.10.0", "flag", "boolean"), ("0.10.0", "x", "float")], "feature_schema_version string, export_name string, data_type string")
    whole = unified(frame(spark, {1: [{"old": "1.5", "flag": "maybe", "x": "1e3"}, {"new": 10**30, "x": None}, {"n": 7, "flag": True}], 2: [{"m": "abc"}]}), evolution, schema)
    assert {tuple(r) for r in uncast(whole).collect()} == {("p", 1, "new", 2), ("p", 1, "flag", 1), ("p", 2, "new", 1)}


def test_too_large_a_registry_is_an_error(spark, evolution):
    from reelgrain.session import small_rows

    assert len(small_rows(evolution, 4)) == 4
    with pytest.raises(ValueError):
        small_rows(evolution, 3)
