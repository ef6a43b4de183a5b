"""Queries of operators.stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import stats as s
from quarrymill.operators.filters import export_eligible
from quarrymill.plans.registry import register

TRIGGERS = ["then", "Elle"]
HIT = "(contains(lower(text), 'then') OR contains(lower(text), 'elle'))"

register(
    "project_counters", lambda t: s.project_counters(t.assets),
    "SELECT project_id, count(*) AS asset_count, count(*) FILTER (review_state IN ('approved', 'rejected')) AS reviewed, count(*) FILTER (is_flagged) AS flagged, count(*) FILTER (is_rejected) AS rejected FROM assets GROUP BY 1",
)
register(
    "project_stats", lambda t: s.project_stats(t.assets),
    """SELECT *, total - approved - rejected AS pending, round(100.0::DOUBLE * captioned / total, 1) AS coverage_pct FROM (
         SELECT project_id, count(*) AS total, count(*) FILTER (review_state = 'approved') AS approved, count(*) FILTER (is_rejected) AS rejected, count(active_caption_id) AS captioned, count(composite_score) AS scored,
           count(*) FILTER (analyzed) AS embedded, round(avg(composite_score), 6) AS avg_score, count(*) FILTER (composite_score >= 0.7) AS high, count(*) FILTER (composite_score < 0.4) AS low FROM assets GROUP BY 1)""",
)
BUCKETS = """WITH counts AS (SELECT project_id, CAST(least(floor({x}), 9) AS INT) AS bucket, count(*) AS n FROM assets {where} GROUP BY 1, 2)
  SELECT p.project_id, CAST(b AS INT) AS bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT project_id FROM assets) p CROSS JOIN range(10) r(b) LEFT JOIN counts c ON p.project_id = c.project_id AND b = c.bucket"""
register("score_histogram", lambda t: s.score_histogram(t.assets), BUCKETS.format(x="composite_score * 10", where="WHERE composite_score IS NOT NULL"))
register("coach_score_buckets", lambda t: s.coach_score_buckets(t.assets), BUCKETS.format(x="coalesce(composite_score, 0) * 100 / 10", where=""))
COUNTS = "SELECT project_id, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, f) AS rank FROM (SELECT project_id, {c} AS value, count(*) AS n, min(position) AS f FROM assets WHERE {c} IS NOT NULL GROUP BY 1, 2)) {most}"
register("shot_type_counts", lambda t: s.value_counts(t.assets, "shot_type"), COUNTS.format(c="shot_type", most=""))
register("emotion_counts", lambda t: s.value_counts(t.assets, "dominant_emotion", 6), COUNTS.format(c="dominant_emotion", most="WHERE rank <= 6"))
ANGLE = "CASE WHEN abs(head_pose_yaw) < 15 THEN 'front' WHEN abs(head_pose_yaw) <= 45 THEN '3quarter' WHEN abs(head_pose_yaw) > 45 THEN 'profile' ELSE 'unknown' END"
BACKGROUND = "CASE WHEN is_indoor THEN 'indoor' WHEN NOT is_indoor THEN 'outdoor' ELSE coalesce(scene_class, 'unknown') END"
register(
    "coach_distributions", lambda t: s.coach_distributions(t.assets),
    f"""WITH long AS (SELECT project_id, 'shot' AS dimension, coalesce(shot_type, 'unknown') AS bucket FROM assets UNION ALL SELECT project_id, 'angle', {ANGLE} FROM assets
         UNION ALL SELECT project_id, 'expression', coalesce(dominant_emotion, 'unknown') FROM assets WHERE face_count > 0 UNION ALL SELECT project_id, 'background', {BACKGROUND} FROM assets)
       SELECT project_id, dimension, bucket, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, 1 AS n FROM long UNION ALL SELECT project_id, 'angle', b, 0 FROM (SELECT DISTINCT project_id FROM assets) CROSS JOIN (VALUES ('front'), ('3quarter'), ('profile'), ('unknown')) v(b)) GROUP BY 1, 2, 3""",
)
register(
    "coach_metrics", lambda t: s.coach_metrics(t.assets, t.captions, TRIGGERS),
    f"""WITH j AS (SELECT a.*, c.text FROM assets a LEFT JOIN (SELECT * FROM captions WHERE is_active) c ON a.asset_id = c.asset_id),
       d AS (SELECT project_id, CAST(sum(n - 1) AS BIGINT) AS exact_duplicates FROM (SELECT project_id, sha256_hash, count(*) AS n FROM assets GROUP BY 1, 2) GROUP BY 1)
       SELECT j.project_id, count(*) AS total, round(avg(composite_score), 6) AS avg_composite, count(*) FILTER (coalesce(composite_score, 0) < 0.4) AS low_quality, count(*) FILTER (coalesce(technical_quality, 0) < 0.3) AS blurry,
         count(DISTINCT duplicate_cluster_id) AS near_dup_clusters, round(avg(CASE WHEN duplicate_cluster_id IS NULL THEN 0 ELSE 1 END), 6) AS redundancy, round(avg(length(text)), 6) AS caption_avg_length,
         round(avg(CASE WHEN text IS NULL THEN NULL WHEN {HIT} THEN 1 ELSE 0 END), 6) AS trigger_coverage, greatest(count(DISTINCT identity_cluster_id), 1) AS unique_identities, count(*) FILTER (face_count > 1) AS multi_subject,
         round(avg(face_quality), 6) AS mean_face_quality, count(*) FILTER (review_state = 'approved') AS approved, count(*) FILTER (text IS NULL) AS uncaptioned, any_value(exact_duplicates) AS exact_duplicates
       FROM j JOIN d ON j.project_id = d.project_id GROUP BY 1""",
)
OFF = f"(regexp_matches(text, '{s.UNEVEN}') OR length(text) NOT BETWEEN 10 AND 800)"


def consistency(triggers: list[str]) -> str:
    """SQL of caption_consistency; a text's length is NULL where it is empty."""
    hits = [f"contains(lower(text), '{w.lower()}')" for w in triggers]
    hit = f"({' OR '.join(hits) or 'FALSE'})"
    advice = ["CASE WHEN uncaptioned > 0 THEN 'missing' END", "CASE WHEN inconsistent > 0 THEN 'format' END", *(f"CASE WHEN 2 * has_{i} < greatest(texts, 1) THEN 'trigger:{w}' END" for i, w in enumerate(triggers)), "CASE WHEN mean_length < 30 THEN 'short' END", "CASE WHEN mean_length > 0 AND sd_length > 0.5::DOUBLE * mean_length THEN 'varied' END"]
    return f"""WITH j AS (SELECT a.project_id, text, length(nullif(text, '')) AS len FROM assets a LEFT JOIN (SELECT * FROM captions WHERE is_active) c ON a.asset_id = c.asset_id),
         g AS (SELECT project_id, count(text) AS captioned, count(*) FILTER (text IS NULL) AS uncaptioned, count(len) AS texts, round(coalesce(avg(len), 0), 6) AS mean_length, round(coalesce(stddev_samp(len), 0), 6) AS sd_length,
           count(*) FILTER (len > 0 AND {hit}) AS with_trigger, count(*) FILTER (len > 0 AND NOT {hit}) AS without_trigger, count(*) FILTER ({OFF}) AS inconsistent {"".join(f", count(*) FILTER ({h}) AS has_{i}" for i, h in enumerate(hits))} FROM j GROUP BY 1)
         SELECT project_id, captioned, uncaptioned, texts, mean_length, sd_length, with_trigger, without_trigger, inconsistent, CASE WHEN captioned = 0 THEN 'none' ELSE coalesce(nullif(concat_ws(',', {", ".join(advice)}), ''), 'good') END AS recommendations FROM g"""


register("caption_consistency", lambda t: s.caption_consistency(t.assets, t.captions, TRIGGERS), consistency(TRIGGERS))
register("caption_inconsistent", lambda t: s.inconsistent_captions(t.captions), f"SELECT project_id, asset_id FROM captions WHERE is_active AND {OFF}")
register(
    "caption_word_counts", lambda t: s.caption_word_counts(t.captions.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "z"))),
    r"""WITH w AS (SELECT project_id, asset_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7f]', 'z', 'g')), '\b[a-z][a-z''-]{1,}\b')) AS word, generate_subscripts(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7f]', 'z', 'g')), '\b[a-z][a-z''-]{1,}\b'), 1) AS place FROM captions WHERE is_active),
       c AS (SELECT project_id, word, count(*) AS n, min(asset_id * 100000 + place) AS f FROM w GROUP BY 1, 2)
       SELECT project_id, word, n, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, f) AS rank, 'top' AS kind FROM c QUALIFY rank <= 20
       UNION ALL SELECT project_id, word, n, row_number() OVER (PARTITION BY project_id ORDER BY f) AS rank, 'once' AS kind FROM c WHERE n = 1 QUALIFY rank <= 20""",
)
COVERAGE = "SELECT project_id, captioned + uncaptioned AS total, captioned, round(100.0::DOUBLE * captioned / (captioned + uncaptioned), 1) AS coverage_pct, CAST(round_even(round(mean_length, 1), 0) AS BIGINT) AS avg_length, inconsistent, recommendations FROM g2"
register("caption_coverage", lambda t: s.caption_coverage(t.assets, t.captions), f"WITH g2 AS ({consistency([])}) {COVERAGE}")
register(
    "embedding_coverage", lambda t: s.embedding_coverage(t.assets, t.vectors),
    "SELECT *, round(100.0::DOUBLE * done / total, 1) AS pct FROM (SELECT a.project_id, count(*) AS total, count(*) FILTER (analyzed) AS done, count(*) FILTER (NOT analyzed) AS pending, count(vec_id) AS vectors FROM assets a LEFT JOIN vectors ON asset_id = vec_id GROUP BY 1)",
)
register(
    "provider_benchmark", lambda t: s.provider_benchmark(t.usage, t.assets),
    """WITH j AS (SELECT u.*, ok AND a.asset_id IS NOT NULL AS good FROM usage u LEFT JOIN assets a ON u.asset_id = a.asset_id),
       l AS (SELECT provider, list_sort(list(latency_ms)) AS v, list_sort(list(asset_id))[1:3] AS few FROM j WHERE good GROUP BY 1),
       b AS (SELECT provider, count(*) AS calls, count(*) FILTER (NOT good) AS errors, round(coalesce(avg(latency_ms) FILTER (good), 0), 6) AS mean_latency, round(avg(CASE WHEN good THEN 1 ELSE 0 END), 6) AS success_rate FROM j GROUP BY 1)
       SELECT b.*, coalesce(v[CAST(greatest(floor(0.95 * len(v)) - 1, 0) AS BIGINT) + 1], 0.0::DOUBLE) AS p95_latency, coalesce(array_to_string(few, ','), '') AS samples FROM b LEFT JOIN l ON b.provider = l.provider""",
)
register(
    "usage_summary", lambda t: s.usage_summary(t.usage),
    "SELECT provider, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, round(avg(latency_ms), 6) AS mean_latency FROM usage GROUP BY 1",
)
CLUSTERS = """SELECT project_id, duplicate_cluster_id, coalesce(min(duplicate_type), 'unknown') AS type, count(*) AS n, CAST(arg_max(asset_id, row(coalesce(composite_score, 0), coalesce(training_usefulness, 0), coalesce(technical_quality, 0), coalesce(face_quality, 0), width * height, imported_at, asset_id)) AS BIGINT) AS best_id
       FROM assets WHERE NOT is_rejected AND duplicate_cluster_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"""
register("duplicate_clusters", lambda t: s.duplicate_clusters(t.assets), f"SELECT *, count(*) OVER (PARTITION BY project_id) AS total_clusters, CAST(sum(n - 1) OVER (PARTITION BY project_id) AS BIGINT) AS total_duplicates FROM ({CLUSTERS})")
register("duplicate_cluster_members", lambda t: s.duplicate_cluster_members(t.assets), f"SELECT a.project_id, a.duplicate_cluster_id, c.type, c.n, a.asset_id, a.asset_id = best_id AS keep, coalesce(a.composite_score, 0::DOUBLE) AS score FROM assets a JOIN ({CLUSTERS}) c ON a.project_id = c.project_id AND a.duplicate_cluster_id = c.duplicate_cluster_id WHERE NOT a.is_rejected")
register(
    "export_preview", lambda t: s.export_preview(export_eligible(t.assets, min_score=0.2)),
    "SELECT project_id, count(*) AS count, count(active_caption_id) AS captioned, count(*) - count(active_caption_id) AS uncaptioned FROM assets WHERE NOT is_rejected AND composite_score >= 0.2 GROUP BY 1",
)
register(
    "export_validate", lambda t: s.export_validate(t.assets),
    """WITH n AS (SELECT project_id, count(*) AS total, count(*) FILTER (active_caption_id IS NULL) AS uncaptioned, count(*) FILTER (review_state = 'approved') AS approved, count(*) FILTER (coalesce(composite_score, 0) < 0.3) AS low FROM assets WHERE NOT is_rejected GROUP BY 1)
       SELECT project_id, 'few_images' AS warning, total AS n FROM n WHERE total < 15 UNION ALL SELECT project_id, 'under_30', total FROM n WHERE total >= 15 AND total < 30 UNION ALL SELECT project_id, 'uncaptioned', uncaptioned FROM n WHERE uncaptioned > 0
       UNION ALL SELECT project_id, 'none_approved', total FROM n WHERE approved = 0 UNION ALL SELECT project_id, 'low_quality', low FROM n WHERE low > 0""",
)
register(
    "bucket_distribution", lambda t: s.bucket_distribution(t.assets),
    """SELECT project_id, concat(greatest(64, CAST(round_even(sqrt(1048576.0::DOUBLE * (width::DOUBLE / height)) / 64, 0) * 64 AS INT)), 'x', greatest(64, CAST(round_even(sqrt(1048576.0::DOUBLE / (width::DOUBLE / height)) / 64, 0) * 64 AS INT))) AS bucket, count(*) AS n FROM assets GROUP BY 1, 2""",
)
