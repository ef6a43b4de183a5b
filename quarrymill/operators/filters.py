"""Facets, rules and candidate lists over the asset table: each builds one predicate or one ordered page."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTABLE = ("imported_at", "composite_score", "technical_quality", "aesthetic_score", "face_count", "filename", "elo", "file_size")
#: Rule fields and operators; rules with others are skipped.
RULE_FIELDS = ("composite_score", "face_count", "aesthetic_score", "technical_quality", "review_state", "shot_type", "dominant_emotion", "is_augmented", "active_caption_id")
SUMMARY = ("asset_id", "filename", "width", "height", "composite_score", "review_state", "is_flagged", "is_rejected", "shot_type", "face_count", "duplicate_cluster_id")
DETAIL = (*SUMMARY, "file_size", "mime_type", "sha256_hash", "dominant_emotion", "head_pose_yaw", "technical_quality", "aesthetic_score", "face_quality", "training_usefulness", "identity_cluster_id", "mu", "sigma", "elo", "comparisons")


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def facets(
    min_score: float | None = None, max_score: float | None = None, review_state: str | None = None, shot_type: str | None = None, has_face: bool | None = None, flagged: bool | None = None, rejected: bool | None = None,
    identity: str | None = None, has_caption: bool | None = None, has_duplicate: bool | None = None, search: str | None = None, expression: str | None = None, augmented: bool | None = None,
) -> Column:
    """Conjunction of the facets that are given; a NULL score fails any score bound."""
    c = F.col
    there = lambda name, yes: c(name).isNotNull() if yes else c(name).isNull()
    given = [
        (min_score, lambda v: c("composite_score") >= v), (max_score, lambda v: c("composite_score") <= v), (review_state, lambda v: c("review_state") == v), (shot_type, lambda v: c("shot_type") == v),
        (has_face, lambda v: c("face_count") > 0 if v else c("face_count") == 0), (flagged, lambda v: c("is_flagged") == v), (rejected, lambda v: c("is_rejected") == v), (identity, lambda v: c("identity_cluster_id") == v),
        (has_caption, lambda v: there("active_caption_id", v)), (has_duplicate, lambda v: there("duplicate_cluster_id", v)), (search, lambda v: c("filename").ilike(f"%{v}%")), (expression, lambda v: c("dominant_emotion") == v), (augmented, lambda v: c("is_augmented") == v),
    ]
    return every(make(v) for v, make in given if v is not None)


def rule_column(rules: Iterable[dict[str, Any]]) -> Column:
    """Conjunction of rules {field, op, value}; unknown fields and operators are skipped, eq null means IS NULL."""

    def one(rule: dict[str, Any]) -> Column | None:
        field, op, value = rule.get("field"), rule.get("op"), rule.get("value")
        if field not in RULE_FIELDS:
            return None
        c = F.col(field)
        known = {
            "lt": lambda: c < value, "lte": lambda: c <= value, "gt": lambda: c > value, "gte": lambda: c >= value,
            "eq": lambda: c.isNull() if value is None else c == value, "neq": lambda: c.isNotNull() if value is None else c != value,
            "is_null": c.isNull, "is_not_null": c.isNotNull, "contains": lambda: c.cast("string").ilike(f"%{value}%"),
        }
        return known[op]() if op in known else None

    return every(x for x in map(one, rules) if x is not None)


def paginate(df: DataFrame, sort_by: str, descending: bool, page: int, size: int) -> DataFrame:
    """One page with total and has_next; ties by asset_id. An unknown column sorts by imported_at."""
    c = F.col(sort_by if sort_by in SORTABLE else "imported_at")
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "asset_id").offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > page * size)


def smart_filter(assets: DataFrame, rules: Iterable[dict[str, Any]]) -> DataFrame:
    return assets.filter(rule_column(rules))


def auto_sort_preview(assets: DataFrame, rules: dict[str, list[dict[str, Any]]], first: int = 3) -> DataFrame:
    """Per rule: matches, and the first file names by asset_id; one scan for all rules."""
    hits = F.array_compact(F.array(*(F.when(rule_column(r), F.lit(name)) for name, r in rules.items())))
    matched = assets.select("asset_id", "filename", F.explode(hits).alias("rule"))
    lowest = Window.partitionBy("rule").orderBy("asset_id")
    counts = matched.groupBy("rule").agg(F.count("*").alias("matched"))
    names = matched.withColumn("n", F.row_number().over(lowest)).filter(F.col("n") <= first).groupBy("rule").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("n", "filename"))), lambda x: x["filename"])).alias("samples"))
    return counts.join(names, "rule")


def auto_sort_apply(assets: DataFrame) -> DataFrame:
    """The five preset rules in order, each on what the earlier ones left; a fold of columns in one pass."""
    reject = lambda df, when: df.withColumns({"review_state": F.when(when, "rejected").otherwise(F.col("review_state")), "is_rejected": F.when(when, True).otherwise(F.col("is_rejected"))})
    flag = lambda df, when: df.withColumn("is_flagged", F.when(when, True).otherwise(F.col("is_flagged")))
    df = reject(assets, F.col("technical_quality") < 0.3)
    approve = F.col("composite_score") >= 0.7
    df = df.withColumns({"review_state": F.when(approve, "approved").otherwise(F.col("review_state")), "is_rejected": F.when(approve, False).otherwise(F.col("is_rejected"))})
    df = flag(df, F.col("face_count") > 1)
    df = reject(df, F.col("face_count") == 0)
    return flag(df, F.col("active_caption_id").isNull())


def export_eligible(assets: DataFrame, ids: DataFrame | None = None, captioned: bool = False, approved: bool = False, min_score: float | None = None) -> DataFrame:
    """Live assets, optionally of given ids, captioned, approved, and with at least a score."""
    df = assets.join(ids, "asset_id", "left_semi") if ids is not None else assets
    wanted = [~F.col("is_rejected")]
    wanted += [F.col("review_state") == "approved"] * approved + [F.col("active_caption_id").isNotNull()] * captioned
    wanted += [F.col("composite_score") >= min_score] if min_score is not None else []
    return df.filter(every(wanted))


def top_per_project(df: DataFrame, key: Column, n: int, descending: bool = True) -> DataFrame:
    """The n rows of each project with the highest (or lowest) key, as rank 1 to n; ties by asset_id.

    Rows are first cut to n in each of a fixed number of buckets, so that no task holds a large project.
    """
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("asset_id")]
    bucket = F.pmod(F.xxhash64("asset_id"), F.lit(64))
    cut = df.withColumn("_bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("project_id", "_bucket").orderBy(*order))).filter(F.col("rank") <= n)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).filter(F.col("rank") <= n).drop("_bucket")


def next_best_candidates(assets: DataFrame, n: int = 10, captioned: bool = False, single_face: bool = False, min_score: float = 0.0) -> DataFrame:
    c = F.coalesce("composite_score", F.lit(0.0))
    wanted = [~F.col("is_rejected"), F.col("review_state").isin("pending", "reviewed"), c >= min_score]
    wanted += [F.col("active_caption_id").isNotNull()] * captioned + [F.col("face_count") == 1] * single_face
    key = c - F.when(F.col("duplicate_cluster_id").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("analyzed"), 0.05).otherwise(0.0)
    return top_per_project(assets.filter(every(wanted)).withColumn("key", key), F.col("key"), n)


def remove_candidates(assets: DataFrame, n: int = 20) -> DataFrame:
    key = F.coalesce("composite_score", F.lit(0.0)) - F.when(F.col("duplicate_cluster_id").isNotNull(), 0.3).otherwise(0.0)
    return top_per_project(assets.filter(~F.col("is_rejected")).withColumn("key", key), F.col("key"), n, descending=False)


def remove_first(assets: DataFrame, listed: DataFrame, n: int = 10) -> DataFrame:
    """The n lowest of composite, less .5 for members of a duplicate cluster and assets listed in a duplicate issue."""
    marked = assets.filter(~F.col("is_rejected")).join(listed.select("asset_id").distinct().withColumn("_listed", F.lit(True)), "asset_id", "left")
    low = F.col("duplicate_cluster_id").isNotNull() | F.col("_listed").isNotNull()
    return top_per_project(marked.withColumn("key", F.coalesce("composite_score", F.lit(0.0)) - F.when(low, 0.5).otherwise(0.0)), F.col("key"), n, descending=False)


def judge_filter_sort(assets: DataFrame, results: DataFrame, recommendation: str = "all", sort: str = "composite") -> DataFrame:
    """Assets with their judge results, filtered and sorted (position from 1); missing results last, ties by asset_id."""
    joined = assets.join(results, "asset_id", "left")
    wanted = {"all": F.lit(True), "needs_review": F.col("recommendation").isNull() | (F.col("recommendation") == "needs_review")}.get(recommendation, F.col("recommendation") == recommendation)
    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1)
    key = {"composite": F.col("judge_composite"), "training_value": F.col("training_value"), "confidence": level}[sort]
    return joined.filter(wanted).orderBy(key.desc_nulls_last(), "asset_id")
