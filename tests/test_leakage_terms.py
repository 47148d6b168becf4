from reelgrain.operators import columns as c


def test_every_term_and_name_rule(spark):
    names = ("expected_label", "other_label", "sample_id", "file_path", "source", "notes", "added_at", "batch", "origin", "mode", "clean")
    rows = [("real", "x", "s1", "x", "x", None, "from Kaggle", "PERSONAL", "external", "manual_source", "n/a"), ("fake", None, None, None, None, None, "self_recorded", None, "deepfake", None, "x")]
    got = {r.column_name: (r.severity, r.terms) for r in c.leakage_findings(c.cell_counts(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), names, "expected_label"), "expected_label").collect()}
    assert got == {
        "other_label": ("critical", ""), "sample_id": ("high", ""), "file_path": ("high", ""), "source": ("medium", ""), "notes": ("medium", ""),
        "added_at": ("medium", "kaggle|self_recorded"), "batch": ("medium", "personal"), "origin": ("medium", "deepfake|external|fake"), "mode": ("medium", "manual_source"),
    }
