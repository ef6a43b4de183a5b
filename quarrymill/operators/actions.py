"""Review actions and caption versions as table-to-table transforms; results are written as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "reviewed", "approved", "rejected")
STATE = ("review_state", "is_flagged", "is_rejected", "rejection_reason")


def review_transition(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """assets after updates (asset_id and new values of STATE, NULL where nothing is asked).

    approved clears rejection and its reason, unless one is given; rejected sets rejection. An unknown state is an error.
    """
    u = updates.select("asset_id", *(F.col(c).alias(f"_{c}") for c in STATE), F.lit(True).alias("_asked"))
    bad = F.col("_review_state").isNotNull() & ~F.col("_review_state").isin(*STATES)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unknown review state "), "_review_state"))).otherwise(F.col("_review_state"))
    j = assets.join(u, "asset_id", "left").withColumn("_review_state", checked)
    new = F.col("_review_state")
    rejected = F.when(new == "approved", False).when(new == "rejected", True).otherwise(F.coalesce("_is_rejected", "is_rejected"))
    state = F.coalesce(new, F.when(F.col("_is_rejected"), F.lit("rejected")), F.col("review_state"))
    reason = F.when(new == "approved", F.col("_rejection_reason")).otherwise(F.coalesce("_rejection_reason", "rejection_reason"))
    changed = {"review_state": state, "is_rejected": rejected, "is_flagged": F.coalesce("_is_flagged", "is_flagged"), "rejection_reason": reason}
    return j.select(*(changed.get(c, F.col(c)).alias(c) for c in assets.columns))


def updates_of(ids: DataFrame, state: str | None = None, flagged: bool | None = None, rejected: bool | None = None, reason: str | None = None) -> DataFrame:
    kinds = ("string", "boolean", "boolean", "string")
    return ids.select("asset_id", *(F.lit(v).cast(k).alias(c) for c, v, k in zip(STATE, (state, flagged, rejected, reason), kinds, strict=True))).distinct()


def bulk_action(assets: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """approve, reject, flag, unflag or delete the assets of ids."""
    if action == "delete":
        return assets.join(ids, "asset_id", "left_anti")
    asked = {"approve": {"state": "approved"}, "reject": {"state": "rejected"}, "flag": {"flagged": True}, "unflag": {"flagged": False}}[action]
    return review_transition(assets, updates_of(ids, **asked))


def coach_action(assets: DataFrame, action: str, ids: DataFrame | None = None) -> DataFrame:
    """assets after one of the report's actions; rejections record their reason."""
    from quarrymill.operators.relations import keep_best_sha

    reason = f"Rejected by dataset coach: {action}"
    if action == "remove_exact_duplicates":
        scope = assets.filter("NOT is_rejected")
        scope = scope.join(ids, "asset_id", "left_semi") if ids is not None else scope
        return review_transition(assets, updates_of(keep_best_sha(scope), "rejected", reason="Rejected by dataset coach: exact duplicate"))
    if action in ("remove_low_quality", "reject_by_ids"):
        return review_transition(assets, updates_of(assets.join(ids, "asset_id", "left_semi").filter("NOT is_rejected"), "rejected", reason=reason))
    if action == "approve_high_quality":
        return review_transition(assets, updates_of(assets.join(ids, "asset_id", "left_semi").filter("NOT is_rejected AND review_state <> 'approved'"), "approved"))
    if action in ("flag_multi_face", "flag_no_caption", "flag_blurry"):
        return review_transition(assets, updates_of(assets.join(ids, "asset_id", "left_semi").filter("NOT is_flagged"), flagged=True))
    raise ValueError(f"unknown action {action}")


def apply_duplicate_decisions(assets: DataFrame, overrides: DataFrame) -> DataFrame:
    """assets without the members of duplicate clusters that aren't kept: the best is, unless overrides (asset_id, keep) say else."""
    from quarrymill.operators.relations import cluster_keep_flags

    flags = cluster_keep_flags(assets).select("asset_id", "keep").join(overrides.select("asset_id", F.col("keep").alias("said")), "asset_id", "left")
    return assets.join(flags.filter(~F.coalesce("said", "keep")).select("asset_id"), "asset_id", "left_anti")


def caption_version_append(captions: DataFrame, edit: Column, next_id: Column) -> DataFrame:
    """All versions after a bulk edit: where it changes the active text, the old version closes and a new one is active."""
    new = captions.filter("is_active AND text IS NOT NULL").withColumn("_new", edit).filter("_new <> text")
    opened = new.select(*({"caption_id": next_id, "text": F.col("_new"), "provider": F.lit("bulk_edit")}.get(c, F.col(c)).alias(c) for c in captions.columns))
    gone = new.select("caption_id", F.lit(True).alias("_gone"))
    closed = captions.join(gone, "caption_id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*captions.columns)
    return closed.unionByName(opened)


def caption_version_prune(captions: DataFrame, keep: int) -> DataFrame:
    """Versions without those that aren't active and older than the asset's newest keep."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("created_at"), F.desc("caption_id"))
    return captions.withColumn("_n", F.row_number().over(newest)).filter((F.col("_n") <= keep) | F.col("is_active")).drop("_n")
