"""Dataset report: metrics, issue rules, readiness, and the coverage-aware training selection.

Metrics and rules are SQL expressions, so one aggregate per project feeds a table of rules.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.relations import ranked
from quarrymill.operators.stats import background, coach_distributions, coach_score_buckets, head_angle
from quarrymill.operators.tables import small


def n_where(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


BACKGROUND = "CASE WHEN is_indoor THEN 'indoor' WHEN NOT is_indoor THEN 'outdoor' ELSE scene_class END"
#: Per project, over assets with their active caption's text; rejected assets count.
METRICS = {
    "n": "count(1)",
    "shots": "count(DISTINCT CASE WHEN shot_type <> 'unknown' THEN shot_type END)",
    "closeups": n_where("shot_type IN ('closeup', 'extreme_closeup')"),
    "wide": n_where("shot_type IN ('wide', 'full', 'full_body')"),
    "faces": n_where("face_count > 0"),
    "neutral": n_where("face_count > 0 AND coalesce(dominant_emotion, 'neutral') = 'neutral'"),
    "smiles": n_where("face_count > 0 AND dominant_emotion IN ('happy', 'smile')"),
    "yaws": "count(head_pose_yaw)",
    "front": n_where("abs(head_pose_yaw) < 15"),
    "quarter": n_where("abs(head_pose_yaw) >= 15 AND abs(head_pose_yaw) <= 45"),
    "profile": n_where("abs(head_pose_yaw) > 45"),
    "scenes": n_where(f"{BACKGROUND} IS NOT NULL"),
    "backgrounds": f"count(DISTINCT {BACKGROUND})",
    "zero_scores": n_where("composite_score = 0"),
    "below4": n_where("coalesce(composite_score, 0) < 0.4"),
    "below3": n_where("coalesce(composite_score, 0) < 0.3"),
    "scored": "count(composite_score)",
    "avg_score": "avg(composite_score)",
    "clustered": "count(duplicate_cluster_id)",
    "uncaptioned": n_where("text IS NULL"),
    "captioned": "count(text)",
    "no_trigger": n_where("NOT contains(lower(text), 'then')"),
    "avg_length": "avg(length(text))",
    "multi_face": n_where("face_count > 1"),
    "avg_face": "avg(face_quality)",
    "pending": n_where("review_state = 'pending'"),
    "live": n_where("NOT is_rejected"),
}
#: Group, severity, title, condition and affected count, over METRICS, exact_dups and dominant.
RULES = (
    ("size", "critical", "dataset far too small", "n < 15", "n"),
    ("size", "high", "dataset small", "n >= 15 AND n < 30", "n"),
    ("size", "medium", "dataset could be larger", "n >= 30 AND n < 50", "n"),
    ("size", "low", "dataset very large", "n > 1000", "n"),
    ("quality", "critical", "zero scores", "zero_scores > 0", "zero_scores"),
    ("quality", "critical", "many low-quality images", "below4 > 0.20 * n", "below4"),
    ("quality", "high", "several very low-quality images", "below4 <= 0.20 * n AND below4 > 0.05 * n AND below3 > 0.05 * n", "below3"),
    ("quality", "high", "mean quality low", "scored > 0 AND avg_score < 0.5", "scored"),
    ("duplicates", "high", "exact duplicates", "exact_dups > 0", "exact_dups"),
    ("duplicates", "critical", "high near-duplicate share", "clustered > 0.30 * n", "clustered"),
    ("duplicates", "high", "moderate near-duplicate share", "clustered <= 0.30 * n AND clustered > 0.15 * n", "clustered"),
    ("shots", "high", "one shot type only", "shots = 1", "n"),
    ("shots", "high", "too many closeups", "shots <> 1 AND closeups > 0.70 * n", "closeups"),
    ("shots", "medium", "no wide shots", "shots <> 1 AND wide = 0", "n"),
    ("expressions", "high", "all expressions neutral", "faces > 0 AND neutral = faces", "faces"),
    ("expressions", "medium", "no smiles", "faces > 0 AND neutral <> faces AND smiles = 0", "faces"),
    ("expressions", "high", "one expression dominates", "faces > 0 AND neutral <> faces AND dominant > 0.60 * faces", "dominant"),
    ("angles", "high", "all front-facing", "yaws > 0 AND front = yaws", "yaws"),
    ("angles", "medium", "no profile views", "yaws > 0 AND front <> yaws AND profile = 0", "yaws"),
    ("angles", "medium", "no three-quarter views", "yaws > 0 AND front <> yaws AND quarter = 0", "yaws"),
    ("background", "high", "one background only", "scenes > 0 AND backgrounds = 1", "scenes"),
    ("captions", "high", "many images lack captions", "uncaptioned > 0.20 * n", "uncaptioned"),
    ("captions", "high", "trigger missing", "captioned > 0 AND no_trigger > 0", "no_trigger"),
    ("captions", "medium", "captions short", "captioned > 0 AND avg_length < 30", "captioned"),
    ("identity", "high", "many multi-face images", "multi_face > 0.15 * n", "multi_face"),
    ("identity", "high", "faces of low quality", "avg_face < 0.4", "n"),
)
PENALTY = {"critical": 25, "high": 10, "medium": 5, "low": 1}


def metrics(assets: DataFrame, captions: DataFrame) -> DataFrame:
    texts = captions.filter("is_active").select("asset_id", "text")
    base = assets.join(texts, "asset_id", "left").groupBy("project_id").agg(*(F.expr(x).alias(k) for k, x in METRICS.items()))
    exact = assets.groupBy("project_id", "sha256_hash").agg((F.count("*") - 1).alias("x")).groupBy("project_id").agg(F.sum("x").alias("exact_dups"))
    most = assets.filter("face_count > 0").groupBy("project_id", F.coalesce("dominant_emotion", F.lit("neutral")).alias("e")).agg(F.count("*").alias("x")).groupBy("project_id").agg(F.max("x").alias("dominant"))
    return base.join(exact, "project_id").join(most, "project_id", "left").fillna(0, ["dominant"])


def issues(measured: DataFrame) -> DataFrame:
    """project_id, place (of the rule), grp, severity, title, affected: the rules whose conditions hold."""
    rows = F.array_compact(F.array(*(F.expr(f"CASE WHEN {c} THEN struct({i} AS place, '{g}' AS grp, '{s}' AS severity, '{t}' AS title, CAST({a} AS BIGINT) AS affected) END") for i, (g, s, t, c, a) in enumerate(RULES))))
    return measured.select("project_id", F.explode(rows).alias("x")).select("project_id", "x.*")


def readiness(measured: DataFrame, found: DataFrame) -> DataFrame:
    loss = found.groupBy("project_id").agg(F.sum(F.expr("CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTY.items()) + " END")).alias("loss"))
    score = F.greatest(F.lit(0), 100 - F.coalesce("loss", F.lit(0)))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    label = F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "adequate").when(score >= 60, "poor").otherwise("insufficient")
    return measured.select("project_id").join(loss, "project_id", "left").select("project_id", score.cast("long").alias("score"), grade.alias("grade"), label.alias("label"))


def improvement_actions(found: DataFrame) -> DataFrame:
    """project_id, rank, action: "[SEV] title" by severity, then by rule."""
    level = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END")
    text = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title"))
    first = found.groupBy("project_id", text.alias("action")).agg(F.min(F.struct(level.alias("l"), "place")).alias("_at"))
    return first.select("project_id", "action", F.row_number().over(Window.partitionBy("project_id").orderBy("_at")).alias("rank"))


def selection_target(n: F.Column) -> F.Column:
    return F.when(n < 20, n).when(n < 40, F.least(n, F.lit(30))).otherwise(F.least(n, F.lit(50)))


DIMENSIONS = ("shot", "angle", "expression", "background")
#: Bonus for a bucket not covered yet, the buckets without one, and the rarity weights.
BONUS, NO_BONUS, RARITY = (0.8, 0.55, 0.4, 0.3), (None, None, "unknown", "unknown"), (0.25, 0.2, 0.15, 0.1)


def with_selection_score(assets: DataFrame) -> DataFrame:
    """Live assets with their buckets and score: what they are worth apart from coverage."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    px = F.least(F.col("width") * F.col("height") / 1e6, F.lit(4.0))
    base = 4.0 * z("composite_score") + 3.0 * z("training_usefulness") + 2.0 * z("technical_quality") + 1.5 * z("face_quality") + z("aesthetic_score") + z("uniqueness_score") - 1.5 * z("redundancy_score") + 0.1 * px
    base = base + F.when(F.col("review_state") == "approved", 0.4).when(F.col("review_state") == "pending", 0.1).otherwise(0.0)
    base = base + F.when(F.col("face_count") == 1, 0.25).when(F.col("face_count") > 1, -1.5).otherwise(0.0)
    base = base - F.when(F.col("duplicate_cluster_id").isNotNull(), 1.25).otherwise(0.0) - F.when(F.col("is_flagged"), 0.75).otherwise(0.0)
    buckets = {"shot": F.coalesce("shot_type", F.lit("unknown")), "angle": head_angle(), "expression": F.when(F.coalesce("face_count", F.lit(0)) <= 0, "none").otherwise(F.coalesce("dominant_emotion", F.lit("unknown"))), "background": background()}
    live = assets.filter("NOT is_rejected").select("project_id", "asset_id", base.alias("base"), *(v.alias(k) for k, v in buckets.items()))
    score, alone = F.col("base"), live
    for d, w in zip(DIMENSIONS, RARITY, strict=True):
        size = alone.groupBy("project_id", d).agg(F.count("*").alias(f"n_{d}"))
        live = live.join(small(size), ["project_id", d])
        score = score + w / F.col(f"n_{d}")
    return live.select("project_id", "asset_id", *DIMENSIONS, score.alias("score"))


def greedy_heads(rows: pd.DataFrame) -> pd.DataFrame:
    """Scores at which the best asset of each bucket combination is picked; higher ids win ties."""
    seen: list[set[str]] = [set(), set(), set(), set()]
    left, out = rows.to_dict("records"), []
    while left:
        worth = lambda r: (r["score"] + sum(b for d, b, no, s in zip(DIMENSIONS, BONUS, NO_BONUS, seen, strict=True) if r[d] not in s and r[d] != no), r["asset_id"])
        best = max(left, key=worth)
        out.append({"project_id": best["project_id"], "asset_id": best["asset_id"], "effective": worth(best)[0]})
        left.remove(best)
        for d, s in zip(DIMENSIONS, seen, strict=True):
            s.add(best[d])
    return pd.DataFrame(out, columns=["project_id", "asset_id", "effective"])


def training_selection(assets: DataFrame) -> DataFrame:
    """project_id, asset_id, rank, part (recommended, next or rest) in the order of a greedy coverage-aware pick.

    Bonuses only shrink, and once the best asset of a combination of buckets is picked, the others of it earn none: only
    these heads, a few hundred at most, need the sequential pick; one sort by score places all.
    """
    scored = with_selection_score(assets)
    best = scored.groupBy("project_id", *DIMENSIONS).agg(F.max_by(F.struct("asset_id", "score"), F.struct("score", "asset_id")).alias("h")).select("project_id", *DIMENSIONS, "h.*")
    heads = best.groupBy("project_id").applyInPandas(greedy_heads, "project_id string, asset_id long, effective double")
    placed = scored.join(heads, ["project_id", "asset_id"], "left").withColumn("effective", F.coalesce("effective", "score"))
    order = ranked(placed.select("project_id", "asset_id", "effective"), F.col("effective"), F.desc("asset_id"))
    target = selection_target(F.col("total"))
    part = F.when(F.col("rank") <= target, "recommended").when(F.col("rank") <= target + 10, "next").otherwise("rest")
    return order.select("project_id", "asset_id", "rank", part.alias("part"), F.round("effective", 6).alias("effective"))


def coach_report(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """One row per project: size, score, grade, issues by severity, first action, and how many are recommended."""
    m = metrics(assets, captions)
    found = issues(m)
    by = found.groupBy("project_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in PENALTY))
    first = improvement_actions(found).filter("rank = 1").select("project_id", F.col("action").alias("first_action"))
    target = selection_target(F.col("live")).alias("target")
    return m.select("project_id", "n", target).join(readiness(m, found), "project_id").join(by, "project_id", "left").join(first, "project_id", "left")


def coach_report_rows(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """The whole report as rows: project_id, section, item, place (order within the section) and n.

    Sections: readiness (grade and label, n the score), metric (n its value), distribution (dimension and bucket), score
    (buckets of ten), issue (severity and title, n the affected), action, and the assets that are recommended or next.
    """
    m = metrics(assets, captions)
    found = issues(m)
    row = lambda df, section, item, place, n: df.select("project_id", F.lit(section).alias("section"), item.cast("string").alias("item"), place.cast("long").alias("place"), n.cast("double").alias("n"))
    c, none = F.col, F.lit(None)
    values = m.select("project_id", F.posexplode(F.array(*(F.struct(F.lit(k).alias("k"), c(k).cast("double").alias("v")) for k in (*METRICS, "exact_dups", "dominant")))).alias("place", "x"))
    picked = training_selection(assets).filter("part <> 'rest'")
    return reduce(DataFrame.unionByName, [
        row(readiness(m, found), "readiness", F.concat_ws(" ", "grade", "label"), F.lit(0), c("score")),
        row(values, "metric", c("x.k"), c("place"), F.round("x.v", 6)),
        row(coach_distributions(assets), "distribution", F.concat_ws(" ", "dimension", "bucket"), none, c("n")),
        row(coach_score_buckets(assets), "score", c("bucket"), c("bucket"), c("n")),
        row(found, "issue", F.concat_ws(" ", "severity", "title"), c("place"), c("affected")),
        row(improvement_actions(found), "action", c("action"), c("rank"), none),
        *(row(picked.filter(c("part") == part), part, c("asset_id"), c("rank"), F.round("effective", 6)) for part in ("recommended", "next")),
    ])
