"""Queries of the dataset audits, validation and scalar functions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.functions import scalars as sc
from reelgrain.functions.text import digest_hex, present_lower, trimmed_lower
from reelgrain.operators import audit, columns, sequence
from reelgrain.operators import validation as va
from reelgrain.operators.profile import NUMERIC
from reelgrain.session import table

LABEL = "identity.expected_label"


def _flat(s: SparkSession, d: str) -> DataFrame:
    """A row per record, leaves by dotted name."""
    return audit.flatten(table(s, d, "outcome_features").dropDuplicates(["record_id"]), keep=("record_id", "run_id", "load_no"))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest")


def _references(s: SparkSession, d: str) -> DataFrame:
    known = _manifest(s, d).select("sample_id", digest_hex("video_sha256").alias("digest")).filter("sample_id is not null").groupBy("sample_id").agg(F.min("digest").alias("digest"))
    rows = table(s, d, "outcome_features").dropDuplicates(["record_id"]).select("record_id", "sample_id", digest_hex("identity.video_sha256").alias("digest"))
    return va.reference_problems(rows, known, "sample_id", ["digest"]).groupBy("sample_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def _names(s: SparkSession, d: str) -> DataFrame:
    v = F.col("video_name")
    return _manifest(s, d).select("entry_id", sc.safe_name(v).alias("safe"), sc.suffix(v).alias("suffix"), sc.base_name(F.col("feature_file")).alias("base"), F.array_join(sc.tokens(v), "|").alias("tokens"))


def _hamming(s: SparkSession, d: str) -> DataFrame:
    h = F.col("frame_hashes")
    return _manifest(s, d).filter(h.isNotNull()).select("entry_id", sc.hamming(F.get(h, F.lit(0)), F.get(h, F.lit(1))).alias("bits"))


def _numbers(s: SparkSession, d: str) -> DataFrame:
    field = F.explode(F.split("raw_line", "[,;]"))
    return table(s, d, "source_metadata_raw").filter("line_no > 1").select(field.alias("x")).select(sc.number_kind(F.col("x")).alias("kind"), sc.whole_number(F.col("x")).alias("whole")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("total"))


def _repeats(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d).select("entry_id", digest_hex("video_sha256").alias("digest")).filter("digest is not null")
    return va.numbered_repeats(m, "digest", "entry_id").filter("suffix <> ''").select("entry_id", "suffix")


def _limit(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d).select("entry_id", trimmed_lower("expected_label").alias("label")).filter("label is not null")
    return m.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("entry_id"))).filter("k <= 25").select("entry_id", "label")


def _found(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d)
    return va.availability(m.select("entry_id", "video_name"), m.select("video_name", F.col("feature_file").alias("path")), "video_name").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _last_batch(s: SparkSession, d: str, present: bool) -> DataFrame:
    m = _manifest(s, d).select("entry_id", "batch_no", digest_hex("video_sha256").alias("digest"))
    last = m.agg(F.max("batch_no")).first()[0]
    batch = m.filter(F.col("batch_no") == last) if last is not None else m.filter("false")
    return va.existing(batch, m.filter(F.col("batch_no") < last) if last is not None else m, "digest", present).select("entry_id")


def _statuses(s: SparkSession, d: str) -> DataFrame:
    """The status of each step from one schema version to the next, and of none."""
    t = table(s, d, "feature_schema")
    steps = (("0.8.0", "0.9.0"), ("0.9.0", "0.9.2"), ("0.9.2", "0.9.4"), ("0.9.4", "0.10.0"), ("0.10.0", "0.10.0"))
    return reduce(DataFrame.unionByName, (va.schema_status(va.schema_differences(t, a, b)).select(F.lit(a).alias("old"), F.lit(b).alias("new"), "*") for a, b in steps))


QUERIES = {
    "agg19_duplicates": lambda s, d: audit.duplicate_counts(_manifest(s, d).drop("frame_hashes"), ["sample_id", "video_sha256", "feature_file"]),
    "agg20_class_balance": lambda s, d: audit.class_balance(_flat(s, d), LABEL),
    "flt10_findings": lambda s, d: columns.leakage_findings(columns.cell_counts(_manifest(s, d), _manifest(s, d).columns, "expected_label"), "expected_label"),
    "flt11_unsafe_paths": lambda s, d: _manifest(s, d).filter(va.unsafe_path(F.col("video_name")) | va.unsafe_path(F.col("feature_file"))).select("entry_id"),
    "flt12_labels": lambda s, d: _manifest(s, d).select("entry_id", trimmed_lower("expected_label").alias("alias")).join(table(s, d, "label_alias"), "alias", "left").groupBy("expected_label").agg(F.count(F.lit(1)).alias("n")),
    "flt13_label_priority": lambda s, d: _manifest(s, d).join(table(s, d, "label_alias").select("alias", F.col("expected_label").alias("written")), trimmed_lower("expected_label") == F.col("alias"), "left").select("entry_id", va.label_of([F.col("written"), F.nullif(F.regexp_extract("sample_id", r"\A(real|ai_generated)-", 1), F.lit(""))]).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "jon11_references": _references,
    "jon12_known": lambda s, d: _last_batch(s, d, True),
    "jon12_new": lambda s, d: _last_batch(s, d, False),
    "jon14_availability": _found,
    "jon16_schema_differences": lambda s, d: va.schema_differences(table(s, d, "feature_schema"), "0.9.4", "0.10.0"),
    "val11_status": lambda s, d: _statuses(s, d),
    "win21_class_limit": _limit,
    "win22_first_of_digest": lambda s, d: va.first_of_each(_manifest(s, d).select("entry_id", digest_hex("video_sha256").alias("digest")), "digest", "entry_id"),
    "win23_repeats": _repeats,
    "str01_names": _names,
    "num01_kinds": _numbers,
    "num11_hamming": _hamming,
    "str06_sizes": lambda s, d: table(s, d, "orders").select("o_orderkey", sc.human_size((F.col("o_totalprice") * F.col("o_orderkey")).cast("bigint")).alias("size")),
    "jsn02_props": lambda s, d: table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")),
    "set03_differences": lambda s, d: table(s, d, "feature_schema").filter("feature_schema_version = '0.8.0'").select("export_name").exceptAll(table(s, d, "feature_schema").filter("feature_schema_version = '0.10.0'").select("export_name")),
    "set04_common": lambda s, d: table(s, d, "feature_schema").filter("feature_schema_version = '0.8.0'").select("export_name").intersect(table(s, d, "feature_schema").filter("feature_schema_version = '0.10.0'").select("export_name")),
    "cor03_report_fields": lambda s, d: table(s, d, "report_raw").filter("body is not null").select(F.coalesce(F.get_json_object("body", "$.schema_version"), F.lit("?")).alias("version")).groupBy("version").agg(F.count(F.lit(1)).alias("n")),
}

_F = "f AS (SELECT * FROM outcome_features QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_DIG = "CASE WHEN regexp_full_match(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '^(sha-?256[:=]\\s*|0x)', ''), '[0-9a-f]{{64}}') THEN regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '^(sha-?256[:=]\\s*|0x)', '') END"
_fin = "CASE WHEN NOT isnan(CAST({0} AS DOUBLE)) AND NOT isinf(CAST({0} AS DOUBLE)) THEN CAST({0} AS DOUBLE) END"
_miss = "('', 'null', 'none', 'nan', 'na', 'n/a')"
_low = "lower(trim(expected_label, ' ' || chr(9) || chr(10) || chr(13)))"
_ver = lambda v: f"(SELECT export_name, data_type, minimum, maximum FROM feature_schema WHERE feature_schema_version = '{v}')"

_DIFF = """WITH p(old, new) AS (VALUES ('0.8.0', '0.9.0'), ('0.9.0', '0.9.2'), ('0.9.2', '0.9.4'), ('0.9.4', '0.10.0'), ('0.10.0', '0.10.0')),
o AS (SELECT old, new, s.* FROM p JOIN feature_schema s ON s.feature_schema_version = p.old), n AS (SELECT old, new, s.* FROM p JOIN feature_schema s ON s.feature_schema_version = p.new),
d AS (SELECT old, new, export_name, 'removed' AS change, 'breaking' AS severity FROM o ANTI JOIN n USING (old, new, export_name)
UNION ALL SELECT old, new, export_name, 'added', 'potentially_breaking' FROM n ANTI JOIN o USING (old, new, export_name)
UNION ALL SELECT o.old, o.new, o.export_name, UNNEST(list_filter([CASE WHEN o.data_type IS DISTINCT FROM n.data_type THEN 'data_type changed' END, CASE WHEN o.units IS DISTINCT FROM n.units THEN 'units changed' END, CASE WHEN o.minimum IS DISTINCT FROM n.minimum THEN 'minimum changed' END, CASE WHEN o.maximum IS DISTINCT FROM n.maximum THEN 'maximum changed' END], lambda x: x IS NOT NULL)), 'breaking' FROM o JOIN n USING (old, new, export_name))"""

ORACLES = {
    "agg19_duplicates": " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) - count(DISTINCT {k}) AS repeated FROM manifest WHERE lower(trim({k})) NOT IN {_miss}" for k in ("sample_id", "video_sha256", "feature_file")) + " UNION ALL SELECT '*', (SELECT count(*) FROM manifest) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (frame_hashes) FROM manifest))",
    "agg20_class_balance": f"WITH {_F}, c AS (SELECT {LABEL} AS label, count(*) AS n FROM f WHERE {LABEL} IS NOT NULL GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, round(min(n) OVER () / max(n) OVER (), 6) AS balance FROM c",
    "flt10_findings": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, lower(CAST({c} AS VARCHAR)) AS value FROM manifest" for c in ("entry_id", "batch_no", "sample_id", "video_name", "video_sha256", "feature_schema_version", "application_version", "feature_file", "source", "generator_or_camera", "notes", "added_at", "frame_hashes")) + f"""),
t(term) AS (VALUES ('ai'), ('ai_generated'), ('deepfake'), ('external'), ('fake'), ('generated'), ('kaggle'), ('manual_source'), ('personal'), ('real'), ('self_recorded')),
n(column_name, severity) AS (VALUES ('sample_id', 'high'), ('video_name', 'high'), ('feature_file', 'high'), ('source', 'medium'), ('generator_or_camera', 'medium'), ('notes', 'medium')),
h AS (SELECT column_name, string_agg(term, '|' ORDER BY term) AS terms FROM (SELECT DISTINCT column_name, term FROM v JOIN t ON contains(value, term) WHERE trim(value) NOT IN {_miss}) GROUP BY 1)
SELECT column_name, coalesce(n.severity, 'medium') AS severity, coalesce(terms, '') AS terms FROM n FULL JOIN h USING (column_name)""",
    "flt11_unsafe_paths": "SELECT entry_id FROM manifest WHERE regexp_matches(video_name, '^[A-Za-z]:[\\\\/]|^[/\\\\]|(^|[/\\\\])\\.\\.([/\\\\]|$)') OR regexp_matches(feature_file, '^[A-Za-z]:[\\\\/]|^[/\\\\]|(^|[/\\\\])\\.\\.([/\\\\]|$)')",
    "flt12_labels": f"SELECT l.expected_label, count(*) AS n FROM (SELECT {_low} AS alias FROM manifest) m LEFT JOIN label_alias l USING (alias) GROUP BY 1",
    "flt13_label_priority": f"""WITH m AS (SELECT l.expected_label AS w, nullif(regexp_extract(sample_id, '^(real|ai_generated)-', 1), '') AS p FROM (SELECT sample_id, {_low} AS alias FROM manifest) m LEFT JOIN label_alias l USING (alias))
SELECT CASE WHEN w IS NULL OR p IS NULL OR w = p THEN coalesce(w, p) END AS label, count(*) AS n FROM m GROUP BY 1""",
    "jon11_references": f"""WITH {_F}, k AS (SELECT sample_id, min({_DIG.format('video_sha256')}) AS digest FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1),
x AS (SELECT f.sample_id, CASE WHEN k.sample_id IS NULL THEN 'missing' WHEN {_DIG.format('f.identity.video_sha256')} <> k.digest THEN 'digest_differs' END AS rule FROM f LEFT JOIN k ON k.sample_id = f.sample_id)
SELECT sample_id, rule, count(*) AS n FROM x WHERE rule IS NOT NULL GROUP BY 1, 2""",
    "jon12_known": f"WITH m AS (SELECT entry_id, batch_no, {_DIG.format('video_sha256')} AS g FROM manifest) SELECT entry_id FROM m WHERE batch_no = (SELECT max(batch_no) FROM m) AND g IN (SELECT g FROM m WHERE batch_no < (SELECT max(batch_no) FROM m) AND g IS NOT NULL)",
    "jon12_new": f"WITH m AS (SELECT entry_id, batch_no, {_DIG.format('video_sha256')} AS g FROM manifest) SELECT entry_id FROM m WHERE batch_no = (SELECT max(batch_no) FROM m) AND (g IS NULL OR g NOT IN (SELECT g FROM m WHERE batch_no < (SELECT max(batch_no) FROM m) AND g IS NOT NULL))",
    "jon14_availability": "WITH p AS (SELECT lower(video_name) AS k, count(DISTINCT feature_file) AS n FROM manifest GROUP BY 1) SELECT CASE WHEN coalesce(trim(video_name), '') = '' THEN 'invalid' WHEN p.n IS NULL THEN 'missing' WHEN p.n > 1 THEN 'ambiguous' ELSE 'found' END AS status, count(*) AS n FROM manifest LEFT JOIN p ON p.k = lower(video_name) GROUP BY 1",
    "jon16_schema_differences": f"{_DIFF} SELECT export_name, change, severity FROM d WHERE old = '0.9.4' AND new = '0.10.0'",
    "val11_status": f"{_DIFF} SELECT p.old, p.new, count(*) FILTER (severity = 'breaking') AS breaking, count(*) FILTER (severity = 'potentially_breaking') AS potentially_breaking, count(severity) AS differences, CASE WHEN bool_or(severity = 'breaking') THEN 'incompatible' WHEN bool_or(severity = 'potentially_breaking') THEN 'requires_regeneration' ELSE 'compatible' END AS status FROM p LEFT JOIN d ON d.old = p.old AND d.new = p.new GROUP BY 1, 2",
    "win21_class_limit": f"SELECT entry_id, {_low} AS label FROM manifest WHERE expected_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_low} ORDER BY entry_id) <= 25",
    "win22_first_of_digest": f"SELECT {_DIG.format('video_sha256')} AS digest, min(entry_id) AS entry_id FROM manifest WHERE {_DIG.format('video_sha256')} IS NOT NULL GROUP BY 1",
    "win23_repeats": f"WITH m AS (SELECT entry_id, row_number() OVER (PARTITION BY {_DIG.format('video_sha256')} ORDER BY entry_id) AS k FROM manifest WHERE {_DIG.format('video_sha256')} IS NOT NULL) SELECT entry_id, format('-dup{{:02d}}', k) AS suffix FROM m WHERE k > 1",
    "str01_names": "SELECT entry_id, coalesce(nullif(trim(regexp_replace(video_name, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'video') AS safe, lower(regexp_extract(string_split(replace(video_name, '\\', '/'), '/')[-1], '(\\.[^.]+)$', 1)) AS suffix, string_split(replace(feature_file, '\\', '/'), '/')[-1] AS base, array_to_string(list_filter(regexp_split_to_array(lower(video_name), '[^a-z0-9]+'), lambda t: t <> ''), '|') AS tokens FROM manifest",
    "num11_hamming": "SELECT entry_id, bit_count(xor(CAST('0x' || frame_hashes[1][1:8] AS BIGINT), CAST('0x' || frame_hashes[2][1:8] AS BIGINT))) + bit_count(xor(CAST('0x' || frame_hashes[1][9:16] AS BIGINT), CAST('0x' || frame_hashes[2][9:16] AS BIGINT))) AS bits FROM manifest WHERE frame_hashes IS NOT NULL",
    "jsn02_props": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
    "set03_differences": f"SELECT export_name FROM {_ver('0.8.0')} EXCEPT ALL SELECT export_name FROM {_ver('0.10.0')}",
    "set04_common": f"SELECT export_name FROM {_ver('0.8.0')} INTERSECT SELECT export_name FROM {_ver('0.10.0')}",
    "cor03_report_fields": "SELECT coalesce(json_extract_string(body, '$.schema_version'), '?') AS version, count(*) AS n FROM report_raw WHERE body IS NOT NULL GROUP BY 1",
    "str06_sizes": "WITH x AS (SELECT o_orderkey, CAST(trunc(o_totalprice * o_orderkey) AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 1024 ** 4 THEN format('{:.2f} TiB', n / 1024 ** 4) WHEN n >= 1024 ** 3 THEN format('{:.2f} GiB', n / 1024 ** 3) WHEN n >= 1024 ** 2 THEN format('{:.2f} MiB', n / 1024 ** 2) WHEN n >= 1024 THEN format('{:.2f} KiB', n / 1024) ELSE format('{} B', n) END AS size FROM x",
}
