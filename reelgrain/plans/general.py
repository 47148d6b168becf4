"""Queries of the general data-processing operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrain.operators import drift, nested, profile, rejects
from reelgrain.session import table

QUERIES = {
    "p1_found": lambda s, d: nested.objects(table(s, d, "report_raw")),
    "p1_transitions": lambda s, d: nested.transitions_table(table(s, d, "report_raw")),
    "p1_events": lambda s, d: nested.events_table(table(s, d, "report_raw")).withColumn("evidence_domains", F.array_join("evidence_domains", ",")),
    "p1_findings": lambda s, d: nested.findings_table(table(s, d, "report_raw")).withColumns({"metrics": F.to_json("metrics"), "source_observation_ids": F.array_join("source_observation_ids", ",")}),
    "p1_artifacts": lambda s, d: nested.artifacts_table(table(s, d, "report_raw")),
    "p2_found": lambda s, d: profile.load_findings(table(s, d, "outcome_features"), table(s, d, "dataset_summary"), table(s, d, "feature_schema")),
    "p2_profile": lambda s, d: profile.column_profile(table(s, d, "outcome_features"), table(s, d, "feature_schema")),
    "p3_found": lambda s, d: rejects.rejected(table(s, d, "source_metadata_raw"), table(s, d, "label_alias")),
    "p3_loaded": lambda s, d: rejects.loaded(table(s, d, "source_metadata_raw"), table(s, d, "label_alias")),
    "p5_found": lambda s, d: drift.changes(table(s, d, "feature_export"), table(s, d, "feature_evolution")),
    "p5_uncast": lambda s, d: drift.uncast(drift.unified(table(s, d, "feature_export"), table(s, d, "feature_evolution"), table(s, d, "feature_schema"))),
    "p5_unified": lambda s, d: drift.unified(table(s, d, "feature_export"), table(s, d, "feature_evolution"), table(s, d, "feature_schema")),
}

_ARRAY = "CASE json_type({0}) WHEN 'ARRAY' THEN {0} WHEN 'VARCHAR' THEN CASE WHEN left(ltrim({0} ->> '$'), 1) = '[' THEN json({0} ->> '$') WHEN left(ltrim({0} ->> '$'), 1) = '{{' THEN json_array(json({0} ->> '$')) WHEN trim({0} ->> '$') <> '' THEN json_array({0}) END WHEN 'NULL' THEN NULL ELSE CASE WHEN {0} IS NOT NULL THEN json_array({0}) END END"
_SECTION = "CASE json_type({0}) WHEN 'VARCHAR' THEN TRY_CAST({0} ->> '$' AS JSON) WHEN 'OBJECT' THEN {0} END"
_EACH = "UNNEST(from_json({0}, '[\"JSON\"]')) AS x, generate_subscripts(from_json({0}, '[\"JSON\"]'), 1) - 1 AS i"


def _each(source: str, keys: str, array: str) -> str:
    return f"SELECT {keys}, {_EACH.format('arr')} FROM (SELECT {keys}, {_ARRAY.format(array)} AS arr FROM {source}) WHERE arr IS NOT NULL"


_P1 = f"""
WITH r AS (SELECT DISTINCT report_id, TRY_CAST(body AS JSON) AS b FROM report_raw WHERE body IS NOT NULL),
s AS (SELECT report_id, {_SECTION.format("coalesce(nullif(b -> 'temporal_analysis', 'null'), b -> 'temporal')")} AS t, {_SECTION.format("(b -> 'unified_evidence')")} AS u FROM r),
n AS ({_each("s", "report_id", "(t -> 'notable_transitions')")}),
e AS ({_each("s", "report_id", "(u -> 'events')")}),
ef AS ({_each("(SELECT report_id, i AS ev, x AS p FROM e WHERE json_type(x) = 'OBJECT')", "report_id, ev", "(p -> 'findings')")}),
ea AS ({_each("(SELECT report_id, i AS ev, x AS p FROM e WHERE json_type(x) = 'OBJECT')", "report_id, ev", "(p -> 'artifact_references')")}),
m AS ({_each("s", "report_id", "(u -> 'ambiguous_findings')")}),
f AS (SELECT report_id, ev, i, x FROM ef UNION ALL SELECT report_id, -1, i, x FROM m),
fa AS ({_each("(SELECT report_id, ev, i AS fi, x AS p FROM f WHERE json_type(x) = 'OBJECT')", "report_id, ev, fi", "(p -> 'artifact_references')")}),
o AS (
SELECT report_id, 'notable_transition' AS kind, -1 AS event_pos, -1 AS finding_pos, i AS pos FROM n WHERE json_type(x) = 'OBJECT'
UNION ALL SELECT report_id, 'event', i, -1, i FROM e WHERE json_type(x) = 'OBJECT'
UNION ALL SELECT report_id, 'finding', ev, -1, i FROM f WHERE json_type(x) = 'OBJECT'
UNION ALL SELECT report_id, 'artifact_reference', ev, -1, i FROM ea WHERE json_type(x) <> 'NULL'
UNION ALL SELECT report_id, 'artifact_reference', ev, fi, i FROM fa WHERE json_type(x) <> 'NULL')
SELECT DISTINCT report_id, kind, CAST(event_pos AS INTEGER) AS event_pos, CAST(finding_pos AS INTEGER) AS finding_pos, CAST(pos AS INTEGER) AS pos FROM o
"""


def _p2() -> str:
    values = " UNION ALL ".join(f"SELECT run_id, load_no, '{c}' AS column_name, CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END AS v FROM r" for c in profile.NUMERIC)
    return f"""
WITH r AS (SELECT * FROM outcome_features QUALIFY row_number() OVER (PARTITION BY record_id) = 1),
v AS ({values}),
p AS (SELECT run_id, load_no, column_name, count(*) AS n, count(*) - count(v) AS missing FROM v GROUP BY ALL),
loads AS (SELECT run_id, load_no, lag(load_no) OVER (PARTITION BY run_id ORDER BY load_no) AS before FROM (SELECT DISTINCT run_id, load_no FROM r)),
k AS (SELECT run_id, load_no, column_name, v, count(*) AS k FROM v WHERE v IS NOT NULL GROUP BY ALL),
w AS (
SELECT k.run_id, l.load_no, column_name, v, k.k * 1.0 / sum(k.k) OVER (PARTITION BY k.run_id, l.load_no, column_name) AS d, 1 AS new FROM k JOIN loads l ON k.run_id = l.run_id AND k.load_no = l.load_no WHERE l.before IS NOT NULL
UNION ALL SELECT k.run_id, l.load_no, column_name, v, -k.k * 1.0 / sum(k.k) OVER (PARTITION BY k.run_id, l.load_no, column_name), 0 FROM k JOIN loads l ON k.run_id = l.run_id AND k.load_no = l.before),
both_sides AS (SELECT run_id, load_no, column_name FROM w GROUP BY ALL HAVING count(DISTINCT new) = 2),
c AS (SELECT *, sum(d) OVER (PARTITION BY run_id, load_no, column_name ORDER BY v RANGE UNBOUNDED PRECEDING) AS gap FROM w JOIN both_sides USING (run_id, load_no, column_name)),
found AS (
SELECT v.run_id, v.load_no, column_name, 'range' AS finding FROM v JOIN feature_schema f ON f.export_name = column_name AND f.feature_schema_version = '0.10.0' WHERE v.v < f.minimum OR v.v > f.maximum
UNION ALL SELECT p.run_id, p.load_no, p.column_name, 'null_rate' FROM p JOIN loads l ON p.run_id = l.run_id AND p.load_no = l.load_no JOIN p q ON q.run_id = p.run_id AND q.load_no = l.before AND q.column_name = p.column_name WHERE abs(p.missing * 1.0 / p.n - q.missing * 1.0 / q.n) > {profile.NULL_RATE} + 1e-12
UNION ALL SELECT run_id, load_no, column_name, 'shift' FROM c WHERE abs(gap) > {profile.SHIFT} + 1e-9
UNION ALL SELECT p.run_id, p.load_no, column_name, 'missing_count' FROM p JOIN dataset_summary s ON p.run_id = s.run_id AND p.load_no = s.load_no WHERE coalesce(s.missing_value_count_per_feature[column_name], 0) <> missing
UNION ALL SELECT run_id, load_no, 'identity.video_sha256', 'pattern' FROM r WHERE NOT regexp_full_match(identity.video_sha256, '[0-9a-f]{{64}}')
UNION ALL SELECT run_id, load_no, 'identity.video_name', 'pattern' FROM r WHERE NOT regexp_full_match(identity.video_name, '[^/\\\\]+\\.(mp4|mov|mkv|avi|webm)'))
SELECT DISTINCT run_id, load_no, column_name, finding FROM found
"""


_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_FIELD = '("([^"]|"")*"|[^"{0}]*)'


def _p3() -> str:
    def fields(line: str) -> str:
        one = lambda d: f"list_transform(regexp_extract_all('{d}' || {line}, '{d}(\"(?:[^\"]|\"\")*\"|[^\"{d}]*)', 1), lambda x: CASE WHEN x[1] = '\"' THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
        return f"CASE WHEN semicolon THEN {one(';')} ELSE {one(',')} END"

    quoted = " ".join(f"WHEN {cond} THEN regexp_full_match(line, '{_FIELD.format(d)}({d}{_FIELD.format(d)})*')" for cond, d in (("semicolon", ";"), ("NOT semicolon", ",")))
    get = lambda c: f"trim(coalesce(fields[list_position(names, '{c}')], ''), {_SPACES})"
    numbers = " OR ".join(f"NOT regexp_full_match({get(c)}, '[0-9]*')" for c in rejects.NUMBERS)
    return f"""
WITH h AS (SELECT file_name, regexp_replace(regexp_replace(arg_min(raw_line, raw_id), chr(13) || '$', ''), '^' || chr(65279), '') AS line FROM source_metadata_raw WHERE line_no = 1 GROUP BY 1),
h2 AS (SELECT file_name, contains(line, ';') AS semicolon, line FROM h),
h3 AS (SELECT file_name, semicolon, list_transform({fields("line")}, lambda x: lower(trim(x, {_SPACES}))) AS names FROM h2),
l AS (SELECT raw_id, coalesce(semicolon, false) AS semicolon, coalesce(names, []) AS names, regexp_replace(coalesce(raw_line, ''), chr(13) || '$', '') AS line FROM source_metadata_raw r LEFT JOIN h3 USING (file_name) WHERE line_no IS NULL OR line_no <> 1),
q AS (SELECT *, CASE {quoted} END AS ok FROM l),
f AS (SELECT *, CASE WHEN ok THEN {fields("line")} END AS fields FROM q),
c AS (SELECT raw_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(fields) <> len(names) THEN 'column_count'
 WHEN lower({get("label")}) NOT IN (SELECT alias FROM label_alias) THEN 'label'
 WHEN {get("path")} = '' OR regexp_matches({get("path")}, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$)') THEN 'path'
 WHEN {numbers} THEN 'number' END AS reason FROM f)
SELECT raw_id, reason FROM c WHERE reason IS NOT NULL
"""


_P5 = """
WITH RECURSIVE steps AS (
SELECT id AS name, id AS spot, 0 AS n FROM feature_evolution
UNION ALL SELECT s.name, e.id, s.n + 1 FROM steps s JOIN feature_evolution e ON e.renamed_from = s.spot WHERE s.n < 50),
last AS (SELECT name, arg_max(spot, n) AS id FROM steps GROUP BY 1),
names AS (SELECT name, id FROM last UNION ALL SELECT a.alias, l.id FROM (SELECT id, UNNEST(aliases) AS alias FROM feature_evolution) a JOIN last l ON l.name = a.id WHERE a.alias NOT IN (SELECT name FROM last)),
r AS (SELECT producer, file_no, TRY_CAST(payload AS JSON) AS p FROM feature_export),
k AS (SELECT producer, file_no, p, UNNEST(json_keys(p)) AS name FROM (SELECT DISTINCT producer, file_no, p FROM r WHERE json_type(p) = 'OBJECT')),
f AS (SELECT producer, file_no, name, json_type(json_extract(p, '$."' || name || '"')) AS t FROM k),
present AS (SELECT producer, file_no, coalesce(n.id, f.name) AS feature_id, list_sort(list(DISTINCT f.name)) AS names,
 CASE WHEN bool_or(t IN ('VARCHAR', 'OBJECT', 'ARRAY')) THEN 'string' WHEN bool_or(t = 'DOUBLE') THEN 'float' WHEN bool_or(t IN ('BIGINT', 'UBIGINT', 'HUGEINT')) THEN 'integer' WHEN bool_or(t = 'BOOLEAN') THEN 'boolean' END AS kind
 FROM f LEFT JOIN names n ON n.name = f.name WHERE f.name NOT IN ('sample_id', 'identity.feature_schema_version') GROUP BY 1, 2, 3),
ver AS (SELECT producer, file_no, max(list_transform(regexp_extract_all(p ->> '$."identity.feature_schema_version"', '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS v FROM r GROUP BY 1, 2),
files AS (SELECT producer, file_no, v, row_number() OVER w AS k, lead(file_no) OVER w AS next_file FROM ver WINDOW w AS (PARTITION BY producer ORDER BY file_no)),
a AS (SELECT p.*, f.k, f.v, f.next_file FROM present p JOIN files f USING (producer, file_no)),
out AS (
SELECT b.producer, b.file_no, b.feature_id, 'added' AS change FROM a b WHERE b.k > 1 AND NOT EXISTS (SELECT 1 FROM a c WHERE c.producer = b.producer AND c.feature_id = b.feature_id AND c.k = b.k - 1)
UNION ALL SELECT b.producer, b.next_file, b.feature_id, 'removed' FROM a b WHERE b.next_file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a c WHERE c.producer = b.producer AND c.feature_id = b.feature_id AND c.k = b.k + 1)
UNION ALL SELECT b.producer, b.file_no, b.feature_id, 'renamed' FROM a b JOIN a c ON c.producer = b.producer AND c.feature_id = b.feature_id AND c.k = b.k - 1 WHERE b.names <> c.names
UNION ALL SELECT b.producer, b.file_no, b.feature_id, 'retyped' FROM a b JOIN a c ON c.producer = b.producer AND c.feature_id = b.feature_id AND c.k = b.k - 1 WHERE b.kind <> c.kind
UNION ALL SELECT b.producer, b.file_no, b.feature_id, 'deprecated' FROM a b JOIN feature_evolution e ON e.id = b.feature_id WHERE list_transform(regexp_extract_all(e.deprecated_version, '[0-9]+'), lambda x: CAST(x AS BIGINT)) <= b.v)
SELECT producer, file_no, feature_id, change FROM out
"""

ORACLES = {"p1_found": _P1, "p2_found": _p2(), "p3_found": _p3(), "p5_found": _P5}
