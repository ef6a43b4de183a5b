"""Queries of operators.filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import filters as f
from quarrymill.plans.registry import register

RULES = {
    "reject_low": [{"field": "technical_quality", "op": "lt", "value": 0.3}],
    "approve_high": [{"field": "composite_score", "op": "gte", "value": 0.7}],
    "many_faces": [{"field": "face_count", "op": "gt", "value": 1}],
    "no_face": [{"field": "face_count", "op": "eq", "value": 0}],
    "no_caption": [{"field": "active_caption_id", "op": "is_null"}],
}

register(
    "list_assets",
    lambda t: f.paginate(t.assets.filter(f.facets(min_score=0.3, max_score=0.95, review_state="approved", has_face=True, flagged=False, has_caption=True, search="en")), "composite_score", True, 2, 20).select("asset_id", "composite_score", "total", "has_next"),
    """SELECT asset_id, composite_score, total, total > 40 AS has_next FROM (
         SELECT asset_id, composite_score, count(*) OVER () AS total, row_number() OVER (ORDER BY composite_score DESC NULLS LAST, asset_id) AS n FROM assets
         WHERE composite_score >= 0.3 AND composite_score <= 0.95 AND review_state = 'approved' AND face_count > 0 AND NOT is_flagged AND active_caption_id IS NOT NULL AND filename ILIKE '%en%')
       WHERE n > 20 AND n <= 40""",
)
register(
    "search_assets",
    lambda t: t.assets.filter(f.facets(min_score=0.2, expression="happy", shot_type="closeup", augmented=False)).select("asset_id", "project_id", "composite_score"),
    "SELECT asset_id, project_id, composite_score FROM assets WHERE composite_score >= 0.2 AND dominant_emotion = 'happy' AND shot_type = 'closeup' AND NOT is_augmented",
)
register(
    "search_assets_flat",
    lambda t: t.assets.filter(f.facets(has_caption=False, max_score=0.9)).orderBy("asset_id").offset(5).limit(30).select("asset_id", "filename"),
    "SELECT asset_id, filename FROM assets WHERE active_caption_id IS NULL AND composite_score <= 0.9 ORDER BY asset_id LIMIT 30 OFFSET 5",
)
register(
    "paginate",
    lambda t: f.paginate(t.assets, "file_size", False, 3, 25).select("asset_id", "file_size", "total", "has_next"),
    "SELECT asset_id, file_size, (SELECT count(*) FROM assets) AS total, (SELECT count(*) FROM assets) > 75 AS has_next FROM assets ORDER BY file_size NULLS FIRST, asset_id LIMIT 25 OFFSET 50",
)
register(
    "smart_filter",
    lambda t: f.smart_filter(t.assets, [{"field": "composite_score", "op": "gte", "value": 0.5}, {"field": "dominant_emotion", "op": "neq", "value": None}, {"field": "shot_type", "op": "contains", "value": "I"}, {"field": "colour", "op": "eq", "value": 1}, {"field": "face_count", "op": "near", "value": 1}]).select("asset_id", "composite_score", "dominant_emotion", "shot_type"),
    "SELECT asset_id, composite_score, dominant_emotion, shot_type FROM assets WHERE composite_score >= 0.5 AND dominant_emotion IS NOT NULL AND shot_type ILIKE '%I%'",
)
register(
    "auto_sort_preview",
    lambda t: f.auto_sort_preview(t.assets, RULES),
    """WITH hits AS (
         SELECT 'reject_low' AS rule, asset_id, filename FROM assets WHERE technical_quality < 0.3 UNION ALL SELECT 'approve_high', asset_id, filename FROM assets WHERE composite_score >= 0.7
         UNION ALL SELECT 'many_faces', asset_id, filename FROM assets WHERE face_count > 1 UNION ALL SELECT 'no_face', asset_id, filename FROM assets WHERE face_count = 0
         UNION ALL SELECT 'no_caption', asset_id, filename FROM assets WHERE active_caption_id IS NULL)
       SELECT rule, count(*) AS matched, string_agg(filename, '|' ORDER BY asset_id) FILTER (n <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY asset_id) AS n FROM hits) GROUP BY rule""",
)
register(
    "auto_sort_apply",
    lambda t: f.auto_sort_apply(t.assets).select("asset_id", "review_state", "is_rejected", "is_flagged"),
    """SELECT asset_id,
         CASE WHEN face_count = 0 THEN 'rejected' WHEN composite_score >= 0.7 THEN 'approved' WHEN technical_quality < 0.3 THEN 'rejected' ELSE review_state END AS review_state,
         CASE WHEN face_count = 0 THEN TRUE WHEN composite_score >= 0.7 THEN FALSE WHEN technical_quality < 0.3 THEN TRUE ELSE is_rejected END AS is_rejected,
         is_flagged OR face_count > 1 OR active_caption_id IS NULL AS is_flagged FROM assets""",
)
register(
    "judge_filter_sort",
    lambda t: f.judge_filter_sort(t.assets.select("asset_id"), t.assets.filter("asset_id % 3 <> 0").selectExpr("asset_id", "composite_score AS judge_composite", "training_usefulness AS training_value", "CASE asset_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence", "CASE asset_id % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'maybe' WHEN 2 THEN 'remove' ELSE 'needs_review' END AS recommendation"), "needs_review", "confidence").limit(50),
    """WITH r AS (SELECT asset_id, composite_score AS judge_composite, training_usefulness AS training_value, CASE asset_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence, CASE asset_id % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'maybe' WHEN 2 THEN 'remove' ELSE 'needs_review' END AS recommendation FROM assets WHERE asset_id % 3 <> 0)
       SELECT a.asset_id, judge_composite, training_value, confidence, recommendation FROM assets a LEFT JOIN r ON a.asset_id = r.asset_id WHERE recommendation IS NULL OR recommendation = 'needs_review'
       ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END DESC NULLS LAST, a.asset_id LIMIT 50""",
)
register(
    "judge_results_join",
    lambda t: t.assets.select("asset_id", "project_id").join(t.usage.groupBy("asset_id").agg(F.count("*").alias("judged"), F.sum("cost_micros").alias("cost")), "asset_id", "left"),
    "SELECT a.asset_id, project_id, judged, CAST(cost AS BIGINT) AS cost FROM assets a LEFT JOIN (SELECT asset_id, count(*) AS judged, sum(cost_micros) AS cost FROM usage GROUP BY asset_id) u ON a.asset_id = u.asset_id",
)
register(
    "cluster_filters",
    lambda t: t.assets.filter("identity_cluster_id IS NOT NULL").groupBy("project_id", "identity_cluster_id").agg(F.sum("face_count").alias("faces"), F.count("*").alias("n")).filter("faces >= 5"),
    "SELECT project_id, identity_cluster_id, CAST(sum(face_count) AS BIGINT) AS faces, count(*) AS n FROM assets WHERE identity_cluster_id IS NOT NULL GROUP BY ALL HAVING sum(face_count) >= 5",
)
register(
    "export_eligible",
    lambda t: f.export_eligible(t.assets, t.captions.filter("is_active").select("asset_id"), captioned=True, approved=True, min_score=0.4).select("asset_id", "project_id", "composite_score"),
    "SELECT asset_id, project_id, composite_score FROM assets WHERE NOT is_rejected AND review_state = 'approved' AND active_caption_id IS NOT NULL AND composite_score >= 0.4 AND asset_id IN (SELECT asset_id FROM captions WHERE is_active)",
)
register(
    "next_best_candidates",
    lambda t: f.next_best_candidates(t.assets, 10, captioned=True, min_score=0.1).select("project_id", "asset_id", "key", "rank"),
    """SELECT project_id, asset_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY key DESC, asset_id) AS rank FROM (
         SELECT project_id, asset_id, coalesce(composite_score, 0.0::DOUBLE) - CASE WHEN duplicate_cluster_id IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN analyzed THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS key
         FROM assets WHERE NOT is_rejected AND review_state IN ('pending', 'reviewed') AND coalesce(composite_score, 0.0) >= 0.1 AND active_caption_id IS NOT NULL)) WHERE rank <= 10""",
)
register(
    "remove_candidates",
    lambda t: f.remove_candidates(t.assets).select("project_id", "asset_id", "key", "rank"),
    """SELECT project_id, asset_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY key, asset_id) AS rank FROM (
         SELECT project_id, asset_id, coalesce(composite_score, 0.0::DOUBLE) - CASE WHEN duplicate_cluster_id IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS key FROM assets WHERE NOT is_rejected)) WHERE rank <= 20""",
)
register(
    "remove_first",
    lambda t: f.remove_first(t.assets, t.assets.filter("asset_id % 25 = 3").select("asset_id")).select("project_id", "asset_id", "key", "rank"),
    """SELECT project_id, asset_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY key, asset_id) AS rank FROM (
         SELECT project_id, asset_id, coalesce(composite_score, 0.0::DOUBLE) - CASE WHEN duplicate_cluster_id IS NOT NULL OR asset_id % 25 = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS key FROM assets WHERE NOT is_rejected)) WHERE rank <= 10""",
)
register(
    "export_topk",
    lambda t: f.top_per_project(f.export_eligible(t.assets), F.coalesce("composite_score", F.lit(0.0)), 15).select("project_id", "asset_id", "rank"),
    "SELECT project_id, asset_id, rank FROM (SELECT project_id, asset_id, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(composite_score, 0.0) DESC, asset_id) AS rank FROM assets WHERE NOT is_rejected) WHERE rank <= 15",
)
register(
    "pending_augmentations",
    lambda t: t.assets.filter("is_augmented AND review_state = 'pending'").select("asset_id", "project_id", "imported_at").orderBy(F.desc("imported_at"), "asset_id"),
    "SELECT asset_id, project_id, imported_at FROM assets WHERE is_augmented AND review_state = 'pending'",
)
register(
    "auto_fit_targets",
    lambda t: t.assets.filter("NOT is_rejected").join(t.usage.select("asset_id").distinct(), "asset_id", "left_semi").select("asset_id", "project_id"),
    "SELECT asset_id, project_id FROM assets WHERE NOT is_rejected AND asset_id IN (SELECT asset_id FROM usage)",
)
register("field_projection", lambda t: t.assets.select(*f.DETAIL), f"SELECT {', '.join(f.DETAIL)} FROM assets")
