"""Queries of the training-data operators. Those without SQL are tested against brute force in tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.llm import bpe, history, leakage, pieces, sampling, splits
from reelgrain.session import table


def _sampling(operator, spark: SparkSession, d: str) -> DataFrame:
    return operator(table(spark, d, "manifest"), table(spark, d, "label_alias"), table(spark, d, "sampling_target"))


QUERIES = {
    "p4_found": lambda s, d: history.refusals(table(s, d, "manifest")),
    "p6_found": lambda s, d: _sampling(sampling.report, s, d).filter("unmet").select("expected_label", "generator_or_camera"),
    "p6_report": lambda s, d: _sampling(sampling.report, s, d),
    "p6_sample": lambda s, d: _sampling(sampling.draw, s, d),
    "p7_found": lambda s, d: splits.linked(table(s, d, "manifest")),
    "p7_splits": lambda s, d: splits.assign(table(s, d, "manifest"), table(s, d, "split_target"), aliases=table(s, d, "label_alias")),
    "p8_ids": lambda s, d: bpe.encoded(table(s, d, "documents")),
    "p9_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_item")),
    "p10_found": lambda s, d: pieces.oversized(table(s, d, "documents")),
    "p10_pieces": lambda s, d: pieces.pieces(table(s, d, "documents")).select(*(F.col(c) for c in ("doc_id", "piece_no", "n_pieces", "first_token", "end_token", "piece_tokens", "cut", "text"))),
}

_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

_DIGEST = "regexp_replace(lower(trim(video_sha256, ' ' || chr(9) || chr(10) || chr(13))), '^(sha-?256[:=]\\s*|0x)', '')"

ORACLES = {
    "p7_found": f"""
WITH RECURSIVE m AS (SELECT entry_id, CASE WHEN lower(trim(source, {_SPACES})) NOT IN ('', 'null', 'none', 'nan', 'na', 'n/a') THEN lower(trim(source, {_SPACES})) END AS src, CASE WHEN regexp_full_match({_DIGEST}, '[0-9a-f]{{64}}') THEN {_DIGEST} END AS dig FROM manifest),
d AS (SELECT DISTINCT src, dig FROM m WHERE src IS NOT NULL AND dig IS NOT NULL), e AS (SELECT DISTINCT a.src AS x, b.src AS y FROM d a JOIN d b ON a.dig = b.dig AND a.src <> b.src),
r AS (SELECT DISTINCT src AS x, src AS y FROM m WHERE src IS NOT NULL UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
l AS (SELECT x AS src, min(y) AS k FROM r GROUP BY 1), ld AS (SELECT dig, min(k) AS k FROM d JOIN l USING (src) GROUP BY 1),
g AS (SELECT entry_id, coalesce(l.k, ld.k, m.dig) AS group_key FROM m LEFT JOIN l ON l.src = m.src LEFT JOIN ld ON ld.dig = m.dig)
SELECT entry_id, group_key FROM g WHERE group_key IS NOT NULL QUALIFY count(*) OVER (PARTITION BY group_key) > 1
""",
    "p6_found": f"""
WITH m AS (SELECT l.expected_label, lower(trim(generator_or_camera, {_SPACES})) AS generator_or_camera FROM manifest JOIN label_alias l ON l.alias = lower(trim(manifest.expected_label, {_SPACES}))),
c AS (SELECT expected_label, generator_or_camera, count(*) AS n FROM m GROUP BY 1, 2)
SELECT t.expected_label, t.generator_or_camera FROM sampling_target t LEFT JOIN c USING (expected_label, generator_or_camera)
WHERE coalesce(c.n, 0) < greatest(t.min_rows, round(t.target_share * t.sample_size, 9))
""",
}
