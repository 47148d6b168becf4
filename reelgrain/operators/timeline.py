"""An evidence timeline for each entity: candidates with roles, merged events with their members, classes, priorities and caps.

candidates: entity, id, source_type, domain, record_id, start_seconds, end_seconds; optional percentile, artifacts. Anchors
merge into events in time order; a supporting interval belongs to the event that it overlaps most and is context of the
others near it, or an event of its own; contextual intervals are context of every event near them. Joins are by cells of the
time axis and windows are within an entity.

Defined results: candidates without times or with an end before the start take no part; an entity without candidates has no
events; ties go to the earlier start, then the smaller id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrain.operators import intervals, sequence
from reelgrain.session import written

GAP, SPAN = 0.25, 1.25
#: Domains and their groups, anchor types, caps of findings, labels of artifacts in order.
GROUPS = {"metadata": "metadata", "frame_sampling": "visual", "visual_temporal": "visual", "visual_consistency": "visual", "audio_signal": "audio", "provenance": "provenance", "external_model_results": "learned_model"}
ANCHORS = ("sampled_frame_comparison", "ranked_review_transition", "scene_boundary_candidate", "ranked_audio_energy_transition", "ranked_visual_consistency_transition", "clipping_like_audio_interval")
CAPS = {"visual_consistency": 3, "visual_temporal": 3, "audio_signal": 2, "frame_sampling": 1}
ARTIFACT_LABELS = ("before_frame", "after_frame", "absolute_difference", "flow_warp_residual", "combined_heatmap", "detail_residual_heatmap")
VISUAL = ("frame_sampling", "visual_temporal", "visual_consistency")
ROLES = ("anchor", "supporting", "contextual")


def role(source_type: Column, seconds: Column, span: float = SPAN) -> Column:
    """anchor by type; near-static intervals and long silences are contextual, all else supports."""
    long_silence = (source_type == "silence_like_audio_interval") & (seconds > span)
    return F.when(source_type.isin(*ANCHORS), "anchor").when((source_type == "sustained_near_static_interval") | long_silence, "contextual").otherwise("supporting")


def with_roles(rows: DataFrame, span: float = SPAN) -> DataFrame:
    """Sound candidates, times to six decimals, with their role and a candidate_id in order of id."""
    sound = rows.filter("start_seconds is not null and end_seconds >= start_seconds").withColumns({c: F.bround(c, 6) for c in ("start_seconds", "end_seconds")})
    n = F.row_number().over(Window.partitionBy("entity").orderBy("id"))
    return sound.withColumn("role", role(F.col("source_type"), F.col("end_seconds") - F.col("start_seconds"), span)).withColumn("candidate_id", F.format_string("evidence-candidate-%05d", n))


def members(found: DataFrame, gap: float = GAP, span: float = SPAN, cell: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(events: entity, event, start_seconds, end_seconds, standalone; members: entity, event, id, relation), events numbered in time order."""
    of = lambda r: found.filter(F.col("role") == r).select("entity", "id", "start_seconds", "end_seconds")
    anchors, supporting, contextual = map(of, ROLES)
    merged = sequence.merge_anchors(anchors, gap, span)
    group = written(anchors.join(merged, ["entity", "id"]).select("entity", "id", F.col("event").cast("bigint").alias("group"), "start_seconds", "end_seconds"), "anchors")
    extents = group.groupBy("entity", F.col("group").alias("id")).agg(F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"))
    pairs = written(intervals.near_pairs(supporting, extents, gap, cell), "near")
    best = intervals.best_of(pairs).select("entity", F.col("l_id").alias("id"), F.col("r_id").alias("group"))
    others = pairs.select("entity", F.col("l_id").alias("id"), F.col("r_id").alias("group")).join(best, ["entity", "id", "group"], "left_anti")
    alone = supporting.join(best.select("entity", "id"), ["entity", "id"], "left_anti")
    # a standalone event is named by its candidate, below every merged group, so that it comes first on ties
    own = alone.select("entity", (-F.col("id") - 1).alias("id"), "start_seconds", "end_seconds", F.lit(True).alias("standalone"))
    whole = extents.withColumn("standalone", F.lit(False)).unionByName(own)
    number = F.row_number().over(Window.partitionBy("entity").orderBy("start_seconds", "end_seconds", F.when(F.col("standalone"), 0).otherwise(1), F.when(F.col("standalone"), -F.col("id")).otherwise(F.col("id"))))
    events = whole.withColumn("event", number)
    named = events.select("entity", F.col("id").alias("group"), "event")
    near = intervals.near_pairs(contextual, whole.select("entity", "id", "start_seconds", "end_seconds"), gap, cell).select("entity", F.col("l_id").alias("id"), F.col("r_id").alias("group"))
    links = [
        (group.select("entity", "id", "group"), "anchor"), (best, "primary"), (alone.select("entity", "id", (-F.col("id") - 1).alias("group")), "primary"), (others, "context"), (near, "context"),
    ]
    joined = reduce(DataFrame.unionByName, (d.withColumn("relation", F.lit(r)) for d, r in links)).join(named, ["entity", "group"])
    return events.select("entity", "event", "start_seconds", "end_seconds", "standalone"), joined.select("entity", "event", "id", "relation")


def finalised(found: DataFrame, events: DataFrame, linked: DataFrame) -> DataFrame:
    """A row per event: domains, groups, class across domains, and priority with its basis."""
    rows = linked.join(found, ["entity", "id"])
    primary = F.col("relation") != "context"
    group = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in GROUPS.items() for x in p)), F.col("domain")), F.col("domain"))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    optional = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    facts = rows.groupBy("entity", "event").agg(
        text(F.when(primary, F.col("domain"))).alias("domains"), text(group).alias("groups"), F.count_distinct(group).alias("group_count"), F.count_distinct(F.when(F.col("domain").isin(*VISUAL), F.col("domain"))).alias("visual_methods"),
        some(F.col("domain") == "audio_signal").alias("audio"), some(F.col("source_type") == "sustained_near_static_interval").alias("near_static"), some(F.col("source_type") == "ranked_audio_energy_transition").alias("audio_transition"),
        some(primary & F.contains("source_type", F.lit("ranked"))).alias("ranked"), F.count_if(~primary).alias("context_count"), F.count_if(primary).alias("primary_count"), F.coalesce(F.max(optional("percentile", "double")), F.lit(0.0)).alias("percentile"),
        F.size(F.array_distinct(F.flatten(F.collect_list(optional("artifacts", "array<string>"))))).alias("artifacts"),
    )
    visual, audio, methods = F.col("visual_methods") > 0, F.col("audio"), F.col("visual_methods")
    facts = facts.withColumn("class", F.when(visual & audio, "visual_and_audio_aligned").when(F.col("near_static") & audio, "near_static_with_audio_activity").when(methods >= 2, "multiple_visual_methods").when(visual, "visual_only").when(audio, "audio_only").otherwise("other"))
    basis = F.array_compact(F.array(
        F.when(F.col("group_count") >= 2, "multiple_independent_evidence_groups"), F.when(methods >= 2, "multiple_visual_methods"), F.when(visual & audio, "audio_visual_temporal_overlap"), F.when(F.col("ranked"), "ranked_source_findings"),
        F.when(F.col("artifacts") > 0, "review_artifacts_available"), F.when(F.col("context_count") > 0, "contextual_interval_available"),
    ))
    high = (F.col("group_count") >= 2) & ((visual & audio) | (methods >= 2))
    facts = facts.withColumn("basis", basis).withColumn("priority", F.when(high, "high").when((F.size("basis") >= 2) | F.col("ranked"), "moderate").otherwise("low"))
    return events.join(facts, ["entity", "event"]).withColumn("basis", F.array_join("basis", "|"))


def _level(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "moderate", 1).when(c == "low", 2).otherwise(9)


def highlights(final: DataFrame, most: int = 10) -> DataFrame:
    """The first events of each entity by priority, groups, percentile, artifacts, start and number."""
    order = [_level(F.col("priority")), F.desc("group_count"), F.desc("percentile"), F.desc("artifacts"), F.asc("start_seconds"), F.asc("event")]
    return sequence.best_per_group(final, ["entity"], order, most)


def compact_order(final: DataFrame, most: int = 5) -> DataFrame:
    """The first events in the order of the compact report: priority, groups, audio-visual overlap, several methods, ranked sources, percentile, start, number."""
    has = lambda word, kind: F.when(F.contains("basis", F.lit(word)) | (F.col("class") == kind), 0).otherwise(1)
    order = [_level(F.col("priority")), F.desc("group_count"), has("audio_visual_temporal_overlap", "visual_and_audio_aligned"), has("multiple_visual_methods", "multiple_visual_methods"), has("ranked_source_findings", ""), F.desc("percentile"), F.asc("start_seconds"), F.asc("event")]
    return sequence.best_per_group(final, ["entity"], order, most)


def findings(found: DataFrame, linked: DataFrame, caps: Mapping[str, int] | None = None, most: int = 8) -> DataFrame:
    """The findings shown of each event. All of them where they are few and within the caps (or of one domain); else the best of each domain, then the best of all within the caps; one domain alone knows no cap."""
    caps = CAPS if caps is None else caps
    rows = linked.join(found, ["entity", "id"]).withColumn("_role", F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))).withColumn("_ranked", F.when(F.contains("source_type", F.lit("ranked")), 0).otherwise(1))
    event, domain = Window.partitionBy("entity", "event"), Window.partitionBy("entity", "event", "domain")
    order = ["_role", "_ranked", "domain", "record_id", "id"]
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col("domain")), F.lit(most))
    sizes = rows.withColumns({"_n": F.count(F.lit(1)).over(event), "_own": F.count(F.lit(1)).over(domain), "_domain_rank": F.row_number().over(domain.orderBy(*order))})
    sizes = sizes.withColumns({"_one": F.min("domain").over(event) == F.max("domain").over(event), "_over": F.max((F.col("_own") > cap).cast("int")).over(event) > 0})
    passes = (F.col("_n") <= most) & (F.col("_one") | ~F.col("_over"))
    kept = sizes.filter(passes | F.col("_one") | (F.col("_domain_rank") <= cap))
    first = F.when(F.col("_domain_rank") == 1, 0).otherwise(1)
    place = F.row_number().over(event.orderBy(F.when(passes, 0).otherwise(first), F.when(~passes & (first == 0), F.col("domain")), *order))
    return kept.withColumn("place", place).filter(passes | (F.col("place") <= most)).select("entity", "event", "id", "domain", "source_type", "record_id", "place", F.col("_n").alias("available"))


def distinct_findings(rows: DataFrame, keys: Sequence[str] = ("record_id", "domain", "source_type", "summary"), metrics: str = "metrics", order: str = "id", within: Sequence[str] = ("entity", "event")) -> DataFrame:
    """The first finding of each (record, domain, type, names of metrics, summary) within an event; metrics is a map."""
    names = F.array_join(F.array_sort(F.map_keys(metrics)), ",").alias("_names")
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(*within, *(F.col(k).alias(f"_{k}") for k in keys), names).agg(F.min_by(whole, order).alias("r")).select("r.*")


def ordered_artifacts(rows: DataFrame, most: int = 4, within: Sequence[str] = ("entity", "event")) -> DataFrame:
    """Artifacts of each event by preferred label, label and path, each path once, the first `most`."""
    label = F.coalesce("label", F.lit(""))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ARTIFACT_LABELS)), label), F.lit(0)), F.lit(len(ARTIFACT_LABELS) + 1))
    named = rows.filter("path <> ''").withColumns({"_rank": rank, "_label": label})
    once = named.groupBy(*within, "path").agg(F.min(F.struct("_rank", "_label")).alias("k"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy("k", "path"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select(*within, "path", F.col("k._label").alias("label"), "place")


def regional_groups(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Groups of sustained regional intervals (entity, id, times, regions, edge, texture, detail) by first-fit seed: extent, regions and metrics."""
    both = rows.join(seeds, ["entity", "id"])
    return both.groupBy("entity", "seed").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.count(F.lit(1)).alias("intervals"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions")))), ",").alias("regions"),
        F.max("edge").alias("maximum_edge"), F.avg("texture").alias("mean_texture"), F.avg("detail").alias("mean_detail"),
    )


def violations(found: DataFrame, events: DataFrame, linked: DataFrame, span: float = SPAN, known: Sequence[str] = tuple(GROUPS)) -> DataFrame:
    """entity, subject, rule of everything that does not hold in a timeline."""
    role_count = linked.filter("relation <> 'context'").groupBy("entity", "id").agg(F.count(F.lit(1)).alias("n"))
    c = found.join(role_count, ["entity", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = {
        "role unknown": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "domain unknown": ~F.coalesce(F.col("domain").isin(*known), F.lit(False)), "candidate ends before it starts": F.col("start_seconds") > F.col("end_seconds"),
        "anchor not in one event": (F.col("role") == "anchor") & (F.col("n") != 1), "support in several events": (F.col("role") == "supporting") & (F.col("n") > 1), "candidate lost": (F.col("role") != "contextual") & (F.col("n") == 0),
    }
    fired = lambda d, subject, named: d.select("entity", subject.cast("bigint").alias("subject"), F.explode(F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in named.items())))).alias("rule"))
    extent = linked.filter("relation = 'anchor'").join(found.select("entity", "id", F.col("start_seconds").alias("s"), F.col("end_seconds").alias("e")), ["entity", "id"]).groupBy("entity", "event").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    before = Window.partitionBy("entity").orderBy("event")
    e = events.join(extent, ["entity", "event"], "left").withColumns({"ps": F.lag("start_seconds").over(before), "pe": F.lag("end_seconds").over(before)})
    event_rules = {
        "event ends before it starts": F.col("start_seconds") > F.col("end_seconds"), "event without anchor": F.col("s").isNull() & ~F.col("standalone"), "extent is not the anchors'": (F.col("s") != F.col("start_seconds")) | (F.col("e") != F.col("end_seconds")),
        "event too long": F.col("s").isNotNull() & (F.round(F.col("end_seconds") - F.col("start_seconds"), 6) > span), "events out of order": (F.col("ps") > F.col("start_seconds")) | (F.col("ps") == F.col("start_seconds")) & (F.col("pe") > F.col("end_seconds")),
    }
    unknown = linked.join(found.select("entity", "id"), ["entity", "id"], "left_anti").select("entity", F.col("id").alias("subject"), F.lit("member unknown").alias("rule"))
    return fired(c, F.col("id"), rules).unionByName(fired(e, F.col("event"), event_rules)).unionByName(unknown)


def global_evidence(df: DataFrame, key: str, facts: Mapping[str, Column]) -> DataFrame:
    """key, candidate_id, source_type, value of the facts about a whole record that are there, numbered in order."""
    rows = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("source_type"), c.cast("string").alias("value"))) for n, c in facts.items())))
    return df.select(key, F.posexplode(rows).alias("_n", "r")).select(key, F.format_string("global-evidence-%05d", F.col("_n") + 1).alias("candidate_id"), "r.source_type", "r.value")
