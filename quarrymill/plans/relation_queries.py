"""Queries of operators.relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import relations as r
from quarrymill.operators.filters import top_per_project
from quarrymill.operators.vectors import vector_topk
from quarrymill.plans.registry import register, split_columns

QUALITY = "row(coalesce(composite_score, 0), coalesce(training_usefulness, 0), coalesce(technical_quality, 0), coalesce(face_quality, 0), coalesce(aesthetic_score, 0), coalesce(uniqueness_score, 0), -coalesce(redundancy_score, 0), width * height, asset_id)"

register("assets_active_caption", lambda t: r.with_active_caption(t.assets.select("asset_id", "project_id"), t.captions), "SELECT a.asset_id, a.project_id, text FROM assets a LEFT JOIN (SELECT * FROM captions WHERE is_active) c ON a.asset_id = c.asset_id")
register("owned_ids", lambda t: r.owned_ids(t.usage.select("asset_id").distinct().withColumn("project_id", F.concat(F.lit("src"), (F.col("asset_id") % 20).cast("string"))), t.assets), "SELECT DISTINCT u.asset_id, a.project_id FROM usage u JOIN assets a ON u.asset_id = a.asset_id AND a.project_id = concat('src', CAST(u.asset_id % 20 AS STRING))")
SKIPPED = "SELECT session_id, winner AS a, (loser + 1) % 211 AS b FROM comparisons WHERE id % 5 = 0"
SEEN = f"SELECT DISTINCT session_id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT session_id, winner AS a, loser AS b FROM comparisons UNION ALL {SKIPPED})"
skipped = lambda t: t.comparisons.filter("id % 5 = 0").selectExpr("session_id", "winner AS a", "(loser + 1) % 211 AS b")
register("compared_or_skipped", lambda t: r.compared_or_skipped(t.comparisons, skipped(t)), SEEN)
pool = lambda t: t.comparisons.select("session_id", F.explode(F.array("winner", "loser")).alias("asset_id")).distinct()
register(
    "uncompared_pairs", lambda t: r.uncompared_pairs(pool(t), r.compared_or_skipped(t.comparisons, skipped(t))),
    f"""WITH p AS (SELECT DISTINCT session_id, asset_id FROM (SELECT session_id, winner AS asset_id FROM comparisons UNION ALL SELECT session_id, loser FROM comparisons) ), seen AS ({SEEN})
       SELECT x.session_id, x.asset_id AS a, y.asset_id AS b FROM p x JOIN p y ON x.session_id = y.session_id AND x.asset_id < y.asset_id WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.session_id = x.session_id AND s.a = x.asset_id AND s.b = y.asset_id)""",
)
register(
    "text_to_asset_join", lambda t: r.search_results(vector_topk(t.vectors.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "project_id", "embedding AS q"), t.vectors, 5, 0.1), t.assets),
    """WITH s AS (SELECT x.vec_id AS query_id, y.vec_id AS asset_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity FROM vectors x JOIN vectors y ON x.project_id = y.project_id WHERE x.vec_id % 20 = 0),
       k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id) AS rank FROM s WHERE similarity >= 0.1)
       SELECT query_id, rank, asset_id, filename, composite_score, similarity FROM k JOIN assets USING (asset_id) WHERE rank <= 5""",
)
LAST = "SELECT * FROM comparisons QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY made_at DESC, id DESC) = 1"
register("last_comparison", lambda t: r.last_comparison(t.comparisons), LAST)
register(
    "undo_guard", lambda t: r.undo_guard(t.comparisons),
    f"SELECT session_id, id, EXISTS (SELECT 1 FROM comparisons c WHERE c.session_id <> l.session_id AND c.made_at > l.made_at AND (c.winner IN (l.winner, l.loser) OR c.loser IN (l.winner, l.loser))) AS refused FROM ({LAST}) l",
)
register(
    "augmentation_lineage", lambda t: r.augmentation_lineage(t.assets),
    "SELECT a.asset_id, s.asset_id AS source_id, s.review_state, s.is_flagged, FALSE AS is_rejected, coalesce(nullif(a.composite_score, 0), s.composite_score) AS composite_score FROM assets a JOIN assets s ON a.augmentation_source_id = s.asset_id WHERE a.is_augmented",
)
register(
    "cluster_members", lambda t: r.cluster_members(t.assets),
    f"""WITH g AS (SELECT project_id, identity_cluster_id, count(*) AS n, arg_max(asset_id, {QUALITY}) AS representative FROM assets WHERE identity_cluster_id IS NOT NULL GROUP BY 1, 2)
       SELECT a.project_id, a.identity_cluster_id, asset_id, n, representative FROM assets a JOIN g ON a.project_id = g.project_id AND a.identity_cluster_id = g.identity_cluster_id""",
)
register("best_per_cluster", lambda t: r.best_per_cluster(t.assets), f"SELECT project_id, duplicate_cluster_id, arg_max(asset_id, {QUALITY}) AS best_id FROM assets WHERE NOT is_rejected AND duplicate_cluster_id IS NOT NULL GROUP BY 1, 2")
register(
    "cluster_keep_flags", lambda t: r.cluster_keep_flags(t.assets).select("project_id", "duplicate_cluster_id", "asset_id", "place", "keep"),
    """SELECT project_id, duplicate_cluster_id, asset_id, place, place = 1 AS keep FROM (SELECT *, row_number() OVER (PARTITION BY project_id, duplicate_cluster_id ORDER BY coalesce(composite_score, 0) DESC, coalesce(training_usefulness, 0) DESC, coalesce(technical_quality, 0) DESC, coalesce(face_quality, 0) DESC, width * height DESC, imported_at DESC, asset_id DESC) AS place
       FROM assets WHERE duplicate_cluster_id IS NOT NULL)""",
)
register("keep_best_sha", lambda t: r.keep_best_sha(t.assets).select("project_id", "asset_id", "best"), "SELECT * FROM (SELECT project_id, asset_id, first_value(asset_id) OVER (PARTITION BY project_id, sha256_hash ORDER BY coalesce(composite_score, 0) DESC, asset_id) AS best FROM assets) WHERE asset_id <> best")
register("exact_dup_tail", lambda t: r.exact_dup_tail(t.assets).select("project_id", "asset_id", "first"), "SELECT * FROM (SELECT project_id, asset_id, min(position) OVER (PARTITION BY project_id, sha256_hash) AS first FROM assets) WHERE asset_id <> first")
register(
    "leaderboard", lambda t: top_per_project(t.assets.filter("comparisons > 0").withColumn("ordinal", F.col("mu") - 3 * F.col("sigma")), F.col("ordinal"), 100).select("project_id", "asset_id", "rank", "ordinal", "elo", "comparisons", r.confidence().alias("confidence")),
    "SELECT project_id, asset_id, rank, ordinal, elo, comparisons, greatest(0.0::DOUBLE, 1 - sigma / 8.333::DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ordinal DESC, asset_id) AS rank FROM (SELECT *, mu - 3 * sigma AS ordinal FROM assets WHERE comparisons > 0)) WHERE rank <= 100",
)
register(
    "quartile_tier", lambda t: r.tiers(t.assets, F.col("elo")).select("project_id", "asset_id", "rank", "tier"),
    "SELECT project_id, asset_id, rank, CASE WHEN rank <= floor(total * 0.25) THEN 'top' WHEN rank > floor(total * 0.75) THEN 'bottom' ELSE 'middle' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY elo DESC, asset_id) AS rank, count(*) OVER (PARTITION BY project_id) AS total FROM assets)",
)
versions = "SELECT caption_id, asset_id % 300 AS asset_id, created_at FROM captions"
register("active_caption_version", lambda t: r.active_caption_version(t.captions.selectExpr("caption_id", "asset_id % 300 AS asset_id", "created_at")), f"SELECT asset_id, arg_max(caption_id, row(created_at, caption_id)) AS caption_id, count(*) AS versions FROM ({versions}) GROUP BY 1")
FACES = "e.event_id % 700 AS asset_id, e.event_id AS face_index, CAST(e.event_id * 7 % 90 AS DOUBLE) AS x, CAST(e.event_id * 11 % 80 AS DOUBLE) AS y, CAST(10 + e.event_id * 13 % 50 AS DOUBLE) AS w, CAST(10 + e.event_id * 17 % 60 AS DOUBLE) AS h, CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE CAST(e.event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS score"
faces = lambda t: t.spark.read.parquet(f"{t.sf_dir}/events.parquet").alias("e").selectExpr(*split_columns(FACES))
register("primary_face", lambda t: r.primary_face(faces(t)), f"SELECT asset_id, arg_max(face_index, row(w * h * coalesce(score, 0.5), -face_index)) AS face_index FROM (SELECT {FACES} FROM events e) GROUP BY 1")
register(
    "candidate_face_iou", lambda t: r.candidate_face_iou(faces(t), t.assets.filter("asset_id < 700").selectExpr("asset_id", "CAST(asset_id % 40 AS DOUBLE) AS bx", "CAST(asset_id % 30 AS DOUBLE) AS by", "40.0D AS bw", "50.0D AS bh")),
    f"""WITH j AS (SELECT f.*, greatest(0.0::DOUBLE, least(x + w, bx + 40) - greatest(x, bx)) * greatest(0.0::DOUBLE, least(y + h, b.by_ + 50) - greatest(y, b.by_)) AS common FROM (SELECT {FACES} FROM events e) f JOIN (SELECT asset_id, CAST(asset_id % 40 AS DOUBLE) AS bx, CAST(asset_id % 30 AS DOUBLE) AS by_ FROM assets WHERE asset_id < 700) b ON f.asset_id = b.asset_id)
       SELECT asset_id, arg_max(face_index, row(iou, -face_index)) AS face_index, round(max(iou), 6) AS iou FROM (SELECT *, common / (w * h + 2000 - common) AS iou FROM j) WHERE iou > 0 GROUP BY 1""",
)
register("label_by_size", lambda t: r.label_by_size(t.assets), "SELECT *, concat('Person ', CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, least) AS STRING)) AS label FROM (SELECT project_id, identity_cluster_id, count(*) AS n, min(asset_id) AS least FROM assets WHERE identity_cluster_id IS NOT NULL GROUP BY 1, 2)")
PRIORITY = "0.45::DOUBLE * coalesce(training_usefulness, 0) + 0.30::DOUBLE * coalesce(composite_score, 0) + 0.15::DOUBLE * coalesce(technical_quality, 0) + 0.10::DOUBLE * coalesce(face_quality, 0)"
register(
    "candidate_pool", lambda t: r.candidate_pool(t.assets, 24),
    f"""WITH k AS (SELECT project_id, asset_id, row_number() OVER (PARTITION BY project_id ORDER BY {PRIORITY} DESC, asset_id) AS q, row_number() OVER (PARTITION BY project_id ORDER BY comparisons, asset_id) AS l, row_number() OVER (PARTITION BY project_id ORDER BY sigma DESC, asset_id) AS s FROM assets)
       SELECT * FROM (SELECT project_id, asset_id, row_number() OVER (PARTITION BY project_id ORDER BY least(q + CASE WHEN q <= 12 THEN 0 ELSE 3000000 END, l + CASE WHEN l <= 12 THEN 1000000 ELSE 9000000 END, s + CASE WHEN s <= 8 THEN 2000000 ELSE 9000000 END)) AS place FROM k WHERE q <= 24 OR l <= 12 OR s <= 8) WHERE place <= 24""",
)
register("missing_coverage", lambda t: r.missing_coverage(t.assets), "WITH a AS (SELECT * FROM assets) " + " UNION ALL ".join(f"SELECT project_id, '{d}' AS dimension, '{label}' AS label FROM a GROUP BY project_id HAVING count(*) FILTER ({x}) = 0" for d, label, x in r.EXPECTED))
register(
    "augmentation_plan", lambda t: r.augmentation_plan(t.assets),
    """WITH a AS (SELECT * FROM assets WHERE NOT is_rejected),
       g AS (SELECT project_id, count(*) FILTER (shot_type IN ('wide', 'full')) AS wide, count(*) FILTER (round(width::DOUBLE / height, 2) BETWEEN 0.8 AND 1.2) AS square, count(head_pose_yaw) AS yaws, coalesce(max(abs(head_pose_yaw)), 0) AS yaw FROM a GROUP BY 1),
       p AS (SELECT * FROM (SELECT project_id, 'outpaint' AS kind, asset_id, 0.8::DOUBLE AS benefit, 0 AS o, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(composite_score, 0) DESC, asset_id) AS rank FROM a WHERE shot_type IN ('medium', 'closeup')) WHERE rank <= 1
         UNION ALL SELECT * FROM (SELECT project_id, 'crop', asset_id, 0.5::DOUBLE, 1, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(composite_score, 0) DESC, asset_id) AS rank FROM a) WHERE rank <= 1
         UNION ALL SELECT * FROM (SELECT project_id, 'flip', asset_id, 0.4::DOUBLE, 2, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(composite_score, 0) DESC, asset_id) AS rank FROM a WHERE head_pose_yaw IS NOT NULL) WHERE rank <= 3)
       SELECT p.project_id, kind, asset_id, benefit, row_number() OVER (PARTITION BY p.project_id ORDER BY o, rank) AS priority FROM p JOIN g ON p.project_id = g.project_id WHERE (kind = 'outpaint' AND wide = 0) OR (kind = 'crop' AND square = 0) OR (kind = 'flip' AND yaws >= 5 AND yaw < 15)""",
)
