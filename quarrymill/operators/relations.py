"""Joins, windows and set operations over assets, captions, comparisons and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.tables import written

LIVE = "NOT is_rejected"


def zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0))


def quality_order() -> Column:
    """Struct that orders assets by quality: scores, less redundancy, pixels, then the higher id."""
    parts = [zero(c).alias(c) for c in ("composite_score", "training_usefulness", "technical_quality", "face_quality", "aesthetic_score", "uniqueness_score")]
    return F.struct(*parts, (-zero("redundancy_score")).alias("less_redundant"), (F.col("width") * F.col("height")).alias("px"), "asset_id")


def with_active_caption(assets: DataFrame, captions: DataFrame) -> DataFrame:
    return assets.join(captions.filter("is_active").select("asset_id", "text"), "asset_id", "left")


def owned_ids(ids: DataFrame, assets: DataFrame) -> DataFrame:
    return ids.join(assets.select("asset_id", "project_id"), ["asset_id", "project_id"], "left_semi")


def canonical(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def compared_or_skipped(comparisons: DataFrame, skipped: DataFrame) -> DataFrame:
    """Distinct pairs (session, lesser, greater) that were compared or skipped."""
    return comparisons.select("session_id", *canonical(F.col("winner"), F.col("loser"))).union(skipped.select("session_id", *canonical(F.col("a"), F.col("b")))).distinct()


def uncompared_pairs(pool: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs of a session's bounded pool (session_id, asset_id) that were not seen yet."""
    left, right = pool.select("session_id", F.col("asset_id").alias("a")), pool.select("session_id", F.col("asset_id").alias("b"))
    return left.join(right, "session_id").filter("a < b").join(seen, ["session_id", "a", "b"], "left_anti")


def undo_guard(comparisons: DataFrame) -> DataFrame:
    """The last comparison of each session, and whether undo is refused: an asset of it is in another session later.

    Per asset it is enough to know the latest time and the latest time in any session but that one.
    """
    last = last_comparison(comparisons)
    seen = comparisons.select("session_id", "made_at", F.explode(F.array("winner", "loser")).alias("asset_id"))
    per = seen.groupBy("asset_id", "session_id").agg(F.max("made_at").alias("made_at"))
    latest = per.withColumn("n", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("made_at"), "session_id"))).filter("n <= 2")
    two = latest.groupBy("asset_id").agg(F.max_by("session_id", -F.col("n")).alias("s1"), F.max("made_at").alias("t1"), F.max(F.when(F.col("n") == 2, F.col("made_at"))).alias("t2"))
    sides = last.select("session_id", "id", "made_at", F.explode(F.array("winner", "loser")).alias("asset_id"))
    elsewhere = F.when(F.col("s1") != F.col("session_id"), F.col("t1")).otherwise(F.col("t2"))
    return sides.join(two, "asset_id").groupBy("session_id", "id").agg(F.bool_or(F.coalesce(elsewhere > F.col("made_at"), F.lit(False))).alias("refused"))


def last_comparison(comparisons: DataFrame) -> DataFrame:
    row = F.struct(*comparisons.columns)
    return comparisons.groupBy("session_id").agg(F.max_by(row, F.struct("made_at", "id")).alias("row")).select("row.*")


def augmentation_lineage(assets: DataFrame) -> DataFrame:
    """Augmented assets take review state and flag from their source and are not rejected; a composite of 0 or none is the source's."""
    source = assets.select(F.col("asset_id").alias("source_id"), F.col("review_state").alias("state"), F.col("is_flagged").alias("flagged"), F.col("composite_score").alias("before"))
    mine = F.nullif("composite_score", F.lit(0.0))
    return assets.filter("is_augmented").join(source, F.col("augmentation_source_id") == F.col("source_id")).select("asset_id", "source_id", F.col("state").alias("review_state"), F.col("flagged").alias("is_flagged"), F.lit(False).alias("is_rejected"), F.coalesce(mine, "before").alias("composite_score"))


def cluster_members(assets: DataFrame) -> DataFrame:
    """project_id, identity_cluster_id, asset_id of each member, with the number of members and the best one. An identity is
    aggregated before it is joined, so it may hold any share of the assets."""
    members = assets.filter("identity_cluster_id IS NOT NULL")
    groups = members.groupBy("project_id", "identity_cluster_id").agg(F.count("*").alias("n"), F.max_by("asset_id", quality_order()).alias("representative"))
    return members.select("project_id", "identity_cluster_id", "asset_id").join(groups, ["project_id", "identity_cluster_id"])


def search_results(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """The assets that a search has found (query_id, vec_id, score, rank), as its results are shown; hits without an asset are left out."""
    found = hits.select("query_id", "rank", F.col("vec_id").alias("asset_id"), F.col("score").alias("similarity"))
    return found.join(assets.select("asset_id", "filename", "composite_score"), "asset_id").select("query_id", "rank", "asset_id", "filename", "composite_score", "similarity")


def best_per_cluster(assets: DataFrame) -> DataFrame:
    return assets.filter(LIVE).filter(F.col("duplicate_cluster_id").isNotNull()).groupBy("project_id", "duplicate_cluster_id").agg(F.max_by("asset_id", quality_order()).alias("best_id"))


def cluster_keep_flags(assets: DataFrame) -> DataFrame:
    """Members of clusters by quality, then the latest import; the first is kept."""
    order = [zero(c).desc() for c in ("composite_score", "training_usefulness", "technical_quality", "face_quality")] + [(F.col("width") * F.col("height")).desc(), F.desc("imported_at"), F.desc("asset_id")]
    members = assets.filter(F.col("duplicate_cluster_id").isNotNull())
    return members.withColumn("place", F.row_number().over(Window.partitionBy("project_id", "duplicate_cluster_id").orderBy(*order))).withColumn("keep", F.col("place") == 1)


def keep_best_sha(assets: DataFrame) -> DataFrame:
    """Assets to reject: of each content hash all but the best composite (ties: least id). One aggregate, then a join."""
    best = assets.groupBy("project_id", "sha256_hash").agg(F.max_by("asset_id", F.struct(zero("composite_score").alias("s"), (-F.col("asset_id")).alias("i"))).alias("best"))
    return assets.join(best, ["project_id", "sha256_hash"]).filter("asset_id <> best")


def exact_dup_tail(assets: DataFrame) -> DataFrame:
    first = assets.groupBy("project_id", "sha256_hash").agg(F.min("position").alias("first"))
    return assets.join(first, ["project_id", "sha256_hash"]).filter("position <> first")


def confidence() -> Column:
    return F.greatest(F.lit(0.0), 1 - F.col("sigma") / 8.333)


def quartile_tier(rank: Column, total: Column) -> Column:
    return F.when(rank <= F.floor(total * 0.25), "top").when(rank > F.floor(total * 0.75), "bottom").otherwise("middle")


def ranked(assets: DataFrame, key: Column, ids: Column | None = None) -> DataFrame:
    """assets with rank (1 to the project's number of assets, by falling key, then ids, rising asset_id if not given) and total.

    Rows are sorted by range over projects and keys, and counted by project and range, so no task holds a large project.
    """
    order = [F.col("project_id"), F.col("_key").desc_nulls_last(), F.col("asset_id") if ids is None else ids]
    dealt = written(assets.withColumn("_key", key).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("project_id", "_part").agg(F.count("*").alias("_n"))  # a row per project and range
    before = F.sum("_n").over(Window.partitionBy("project_id").orderBy("_part")) - F.col("_n")
    begins = counts.select(F.col("project_id").alias("_project"), F.col("_part").alias("_of"), before.alias("_before"), F.sum("_n").over(Window.partitionBy("project_id")).alias("total"))
    inside = F.row_number().over(Window.partitionBy("project_id", "_part").orderBy(*order[1:]))
    placed = dealt.withColumn("_at", inside).join(begins, F.col("project_id").eqNullSafe(F.col("_project")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn("rank", F.col("_before") + F.col("_at")).drop("_key", "_part", "_at", "_before", "_project", "_of")


def tiers(assets: DataFrame, key: Column) -> DataFrame:
    """assets with rank (1 to the project's number of assets, by falling key, then asset_id), total and tier."""
    return ranked(assets, key).withColumn("tier", quartile_tier(F.col("rank"), F.col("total")))


def active_caption_version(captions: DataFrame) -> DataFrame:
    return captions.groupBy("asset_id").agg(F.max_by("caption_id", F.struct("created_at", "caption_id")).alias("caption_id"), F.count("*").alias("versions"))


def primary_face(faces: DataFrame) -> DataFrame:
    """Per image the face with the largest area times score (.5 without one); ties go to the lowest index."""
    key = F.struct((F.col("w") * F.col("h") * F.coalesce("score", F.lit(0.5))).alias("x"), (-F.col("face_index")).alias("i"))
    return faces.groupBy("asset_id").agg(F.max_by("face_index", key).alias("face_index"))


def candidate_face_iou(faces: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per given box (asset_id, bx, by, bw, bh) the face that overlaps most, where any does."""
    j = faces.join(boxes, "asset_id")
    side = lambda x, w, bx, bw: F.greatest(F.lit(0.0), F.least(F.col(x) + F.col(w), F.col(bx) + F.col(bw)) - F.greatest(x, bx))
    common = side("x", "w", "bx", "bw") * side("y", "h", "by", "bh")
    iou = common / (F.col("w") * F.col("h") + F.col("bw") * F.col("bh") - common)
    j = j.withColumn("iou", iou).filter("iou > 0")
    return j.groupBy("asset_id").agg(F.max_by("face_index", F.struct("iou", (-F.col("face_index")).alias("i"))).alias("face_index"), F.round(F.max("iou"), 6).alias("iou"))


def label_by_size(assets: DataFrame) -> DataFrame:
    """Identities as "Person 1", "Person 2", ... by size; ties by least member."""
    sizes = assets.filter("identity_cluster_id IS NOT NULL").groupBy("project_id", "identity_cluster_id").agg(F.count("*").alias("n"), F.min("asset_id").alias("least"))
    return sizes.withColumn("label", F.concat(F.lit("Person "), F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "least")).cast("string")))


def candidate_pool(assets: DataFrame, size: int = 72, uncertain: bool = False) -> DataFrame:
    """At most size assets per project: three top lists, in order of list and place, then filled up by quality."""
    from quarrymill.functions.quality import priority
    from quarrymill.operators.filters import top_per_project

    quality = priority(*(zero(c) for c in ("training_usefulness", "composite_score", "technical_quality", "face_quality")))
    keys = {"sigma": F.col("sigma"), "quality": quality, "least": -F.col("comparisons")}
    plan = [("sigma", size // 2), ("quality", size // 3), ("least", size // 3)] if uncertain else [("quality", size // 2), ("least", size // 2), ("sigma", size // 3)]
    lists = [top_per_project(assets, keys[k], n).select("project_id", "asset_id", F.lit(i).alias("list"), "rank") for i, (k, n) in enumerate([*plan, ("quality", size)])]
    every = lists[0].union(lists[1]).union(lists[2]).union(lists[3])
    first = every.groupBy("project_id", "asset_id").agg(F.min(F.struct("list", "rank")).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("_at"))).filter(F.col("place") <= size).drop("_at")


#: Coverage that a set should have: dimension, label, and the condition on an asset that provides it.
EXPECTED = (("shot", "wide", "shot_type IN ('wide', 'full')"), ("shot", "closeup", "shot_type = 'closeup'"), ("angle", "profile", "abs(head_pose_yaw) > 45"), ("angle", "3quarter", "abs(head_pose_yaw) >= 15 AND abs(head_pose_yaw) <= 45"), ("expression", "smile", "face_count > 0 AND dominant_emotion = 'happy'"), ("expression", "neutral", "face_count > 0 AND dominant_emotion = 'neutral'"), ("background", "indoor", "is_indoor"), ("background", "outdoor", "NOT is_indoor"))


def missing_coverage(assets: DataFrame) -> DataFrame:
    """project_id, dimension, label of the expected coverage that no asset provides."""
    flags = assets.groupBy("project_id").agg(*(F.bool_or(F.coalesce(F.expr(x), F.lit(False))).alias(f"f{i}") for i, (_, _, x) in enumerate(EXPECTED)))
    rows = F.array_compact(F.array(*(F.when(~F.col(f"f{i}"), F.struct(F.lit(d).alias("dimension"), F.lit(label).alias("label"))) for i, (d, label, _) in enumerate(EXPECTED))))
    return flags.select("project_id", F.explode(rows).alias("x")).select("project_id", "x.*")


def augmentation_plan(assets: DataFrame) -> DataFrame:
    """project_id, kind, asset_id, benefit, priority: what a set lacks and the best assets to make it from."""
    from quarrymill.operators.filters import top_per_project

    live = assets.filter(LIVE)
    ratio = F.round(F.col("width") / F.col("height"), 2)
    has = live.groupBy("project_id").agg(F.bool_or(F.coalesce(F.col("shot_type").isin("wide", "full"), F.lit(False))).alias("wide"), F.bool_or(ratio.between(0.8, 1.2)).alias("square"), F.count("head_pose_yaw").alias("yaws"), F.coalesce(F.max(F.abs("head_pose_yaw")), F.lit(0.0)).alias("yaw"))
    rules = [("outpaint", live.filter(F.col("shot_type").isin("medium", "closeup")), ~F.col("wide"), 0.8, 1), ("crop", live, ~F.col("square"), 0.5, 1), ("flip", live.filter(F.col("head_pose_yaw").isNotNull()), (F.col("yaws") >= 5) & (F.col("yaw") < 15), 0.4, 3)]
    made = [top_per_project(df, zero("composite_score"), n).join(has.filter(gap).select("project_id"), "project_id").select("project_id", F.lit(kind).alias("kind"), "asset_id", F.lit(benefit).alias("benefit"), F.lit(i).alias("_o"), "rank") for i, (kind, df, gap, benefit, n) in enumerate(rules)]
    every = made[0].union(made[1]).union(made[2])
    return every.withColumn("priority", F.row_number().over(Window.partitionBy("project_id").orderBy("_o", "rank"))).drop("_o", "rank")
