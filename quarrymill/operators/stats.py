"""Counters, statistics, histograms and coverage per project. Distinct counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = "NOT is_rejected"


def count_if(condition: Column) -> Column:
    """Rows where the condition is true; 0 on none."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, rounded to 1; 0 of nothing is 0."""
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 1)


def project_counters(assets: DataFrame) -> DataFrame:
    state = F.col("review_state")
    return assets.groupBy("project_id").agg(F.count("*").alias("asset_count"), count_if(state.isin("approved", "rejected")).alias("reviewed"), count_if(F.col("is_flagged")).alias("flagged"), count_if(F.col("is_rejected")).alias("rejected"))


def project_stats(assets: DataFrame) -> DataFrame:
    """Counts over all assets; score statistics over scored ones only."""
    score, state = F.col("composite_score"), F.col("review_state")
    counted = assets.groupBy("project_id").agg(
        F.count("*").alias("total"), count_if(state == "approved").alias("approved"), count_if(F.col("is_rejected")).alias("rejected"), count_if(F.col("active_caption_id").isNotNull()).alias("captioned"),
        F.count("composite_score").alias("scored"), count_if(F.col("analyzed")).alias("embedded"), F.round(F.avg(score), 6).alias("avg_score"), count_if(score >= 0.7).alias("high"), count_if(score < 0.4).alias("low"),
    )
    return counted.withColumns({"pending": F.col("total") - F.col("approved") - F.col("rejected"), "coverage_pct": percent(F.col("captioned"), F.col("total"))})


def with_all_buckets(counts: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """counts (project_id, bucket, n), with zeros for the buckets of each project in keys that have none."""
    every = keys.select("project_id").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return every.join(counts, ["project_id", "bucket"], "left").fillna(0, ["n"])


def score_histogram(assets: DataFrame) -> DataFrame:
    """Ten buckets of floor(10 score) over scored assets."""
    bucket = F.least(F.floor(F.col("composite_score") * 10), F.lit(9)).cast("int").alias("bucket")
    return with_all_buckets(assets.filter("composite_score IS NOT NULL").groupBy("project_id", bucket).agg(F.count("*").alias("n")), assets, 10)


def coach_score_buckets(assets: DataFrame) -> DataFrame:
    """Ten buckets over all assets, a missing score being 0; multiplied in the other order than score_histogram."""
    bucket = F.least(F.floor(F.coalesce("composite_score", F.lit(0.0)) * 100 / 10), F.lit(9)).cast("int").alias("bucket")
    return with_all_buckets(assets.groupBy("project_id", bucket).agg(F.count("*").alias("n")), assets, 10)


def value_counts(assets: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Values by count; ties in the order in which they first come."""
    counts = assets.filter(F.col(column).isNotNull()).groupBy("project_id", F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("position").alias("_first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "_first"))).drop("_first")
    return ranked.filter(F.col("rank") <= most) if most else ranked


def head_angle() -> Column:
    yaw = F.abs("head_pose_yaw")
    return F.when(yaw < 15, "front").when(yaw <= 45, "3quarter").when(yaw > 45, "profile").otherwise("unknown")


def background() -> Column:
    return F.when(F.col("is_indoor"), "indoor").when(~F.col("is_indoor"), "outdoor").otherwise(F.coalesce("scene_class", F.lit("unknown")))


def coach_distributions(assets: DataFrame) -> DataFrame:
    """project_id, dimension, bucket, n; expressions count only assets with faces; head angles are zero-filled."""
    expression = F.when(F.col("face_count") > 0, F.coalesce("dominant_emotion", F.lit("unknown")))
    dims = {"shot": F.coalesce("shot_type", F.lit("unknown")), "angle": head_angle(), "expression": expression, "background": background()}
    long = assets.select("project_id", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in dims.items()))).alias("x")).select("project_id", "x.*").filter("bucket IS NOT NULL")
    counts = long.groupBy("project_id", "dimension", "bucket").agg(F.count("*").alias("n"))
    angles = assets.select("project_id").distinct().select("project_id", F.lit("angle").alias("dimension"), F.explode(F.array(*map(F.lit, ("front", "3quarter", "profile", "unknown")))).alias("bucket"))
    return counts.join(angles, ["project_id", "dimension", "bucket"], "full").fillna(0, ["n"])


def has_trigger(text: Column, triggers: list[str]) -> Column:
    """Whether the text contains any of the words, in any case."""
    return F.exists(F.array(*(F.lit(t.lower()) for t in triggers)), lambda t: F.contains(F.lower(text), t))


def coach_metrics(assets: DataFrame, captions: DataFrame, triggers: list[str]) -> DataFrame:
    """One row per project; rejected assets count. A missing score is 0 in low and blur, and left out of means."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    active = captions.filter("is_active").select("asset_id", "text")
    base = assets.join(active, "asset_id", "left").groupBy("project_id").agg(
        F.count("*").alias("total"), F.round(F.avg("composite_score"), 6).alias("avg_composite"), count_if(zero("composite_score") < 0.4).alias("low_quality"), count_if(zero("technical_quality") < 0.3).alias("blurry"),
        F.count_distinct("duplicate_cluster_id").alias("near_dup_clusters"), F.round(F.avg(F.col("duplicate_cluster_id").isNotNull().cast("int")), 6).alias("redundancy"), F.round(F.avg(F.length("text")), 6).alias("caption_avg_length"),
        F.round(F.avg(F.when(F.col("text").isNotNull(), has_trigger(F.col("text"), triggers).cast("int"))), 6).alias("trigger_coverage"), F.greatest(F.count_distinct("identity_cluster_id"), F.lit(1)).alias("unique_identities"),
        count_if(F.col("face_count") > 1).alias("multi_subject"), F.round(F.avg("face_quality"), 6).alias("mean_face_quality"), count_if(F.col("review_state") == "approved").alias("approved"), count_if(F.col("text").isNull()).alias("uncaptioned"),
    )
    exact = assets.filter("sha256_hash IS NOT NULL").groupBy("project_id", "sha256_hash").agg((F.count("*") - 1).alias("n")).groupBy("project_id").agg(F.sum("n").alias("exact_duplicates"))
    return base.join(exact, "project_id", "left").fillna(0, ["exact_duplicates"])


#: White space as a character class, the same in Java's and RE2's patterns.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"^{SPACE}|{SPACE}\z|  |,{SPACE}*,"


def uneven(text: Column) -> Column:
    """Whether a caption's format is off: blanks at its ends or twice, commas without a word between, below 10 or over 800 characters."""
    return F.regexp_like(text, F.lit(UNEVEN)) | ~F.length(text).between(10, 800)


def inconsistent_captions(captions: DataFrame) -> DataFrame:
    """project_id and asset_id of active captions whose format is off."""
    return captions.filter("is_active").filter(uneven(F.col("text"))).select("project_id", "asset_id")


def caption_consistency(assets: DataFrame, captions: DataFrame, triggers: list[str]) -> DataFrame:
    """Per project: captioned or not, mean length, sample deviation (0 for one), texts with a trigger, off formats, and
    recommendations: missing, format, trigger:<word> (in less than half of the texts), short, varied; or none, good.

    Empty texts have no length and no trigger.
    """
    text = F.col("text")
    has = {w: has_trigger(text, [w]) for w in triggers}
    any_has = has_trigger(text, triggers) if triggers else F.lit(False)
    joined = assets.select("asset_id", "project_id").join(captions.filter("is_active").select("asset_id", "text"), "asset_id", "left").withColumn("len", F.length(F.nullif(text, F.lit(""))))
    told = F.col("len").isNotNull()
    counted = joined.groupBy("project_id").agg(
        F.count("text").alias("captioned"), count_if(text.isNull()).alias("uncaptioned"), F.count("len").alias("texts"), F.round(F.coalesce(F.avg("len"), F.lit(0.0)), 6).alias("mean_length"), F.round(F.coalesce(F.stddev_samp("len"), F.lit(0.0)), 6).alias("sd_length"),
        count_if(told & any_has).alias("with_trigger"), count_if(told & ~any_has).alias("without_trigger"), count_if(uneven(text)).alias("inconsistent"), *(count_if(h).alias(f"_has_{i}") for i, h in enumerate(has.values())),
    )
    advice = {"missing": F.col("uncaptioned") > 0, "format": F.col("inconsistent") > 0, **{f"trigger:{w}": 2 * F.col(f"_has_{i}") < F.greatest("texts", F.lit(1)) for i, w in enumerate(has)}, "short": F.col("mean_length") < 30, "varied": (F.col("mean_length") > 0) & (F.col("sd_length") > 0.5 * F.col("mean_length"))}
    found = F.concat_ws(",", *(F.when(c, k) for k, c in advice.items()))
    out = counted.withColumn("recommendations", F.when(F.col("captioned") == 0, "none").when(found == "", "good").otherwise(found))
    return out.drop(*(f"_has_{i}" for i in range(len(has))))


def caption_coverage(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """Per project: total, captioned, coverage_pct, rounded mean length, off formats and recommendations without triggers."""
    found = caption_consistency(assets, captions, [])
    total = F.col("captioned") + F.col("uncaptioned")
    return found.select("project_id", total.alias("total"), "captioned", percent(F.col("captioned"), total).alias("coverage_pct"), F.rint(F.round("mean_length", 1)).cast("long").alias("avg_length"), "inconsistent", "recommendations")


def caption_word_counts(captions: DataFrame, most: int = 20) -> DataFrame:
    """Per project the most frequent words and the first that come only once; ties by first place."""
    words = captions.filter("is_active AND text IS NOT NULL").select("project_id", "asset_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z][a-z'-]{1,}\b"), 0)).alias("at", "word"))
    counts = words.groupBy("project_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("asset_id", "at")).alias("_first"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "_first"))).filter(F.col("rank") <= most).withColumn("kind", F.lit("top"))
    once = counts.filter("n = 1").withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("_first"))).filter(F.col("rank") <= most).withColumn("kind", F.lit("once"))
    return top.union(once.select(*top.columns)).drop("_first")


def embedding_coverage(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    joined = assets.select("asset_id", "project_id", "analyzed").join(vectors.select(F.col("vec_id").alias("asset_id"), F.lit(1).alias("_v")).distinct(), "asset_id", "left")
    out = joined.groupBy("project_id").agg(F.count("*").alias("total"), count_if(F.col("analyzed")).alias("done"), count_if(~F.col("analyzed")).alias("pending"), F.count("_v").alias("vectors"))
    return out.withColumn("pct", percent(F.col("done"), F.col("total")))


def provider_benchmark(usage: DataFrame, assets: DataFrame, samples: int = 3) -> DataFrame:
    """Per provider: mean latency and p95 of good calls (the value at place max(0, int(.95 n) - 1), 0.0 without any),
    errors, success rate, and the assets of some good calls, least first.

    Calls on assets that don't exist count as errors. The place is sought in two steps, first among classes of latency
    (64 to a power of two), then among the distinct values of one class, so that no provider is gathered in one task.
    """
    joined = usage.join(assets.select("asset_id", F.lit(True).alias("_there")), "asset_id", "left").withColumn("good", F.coalesce(F.col("ok") & F.col("_there").isNotNull(), F.lit(False)))
    good = joined.filter(F.col("good") & F.col("latency_ms").isNotNull())
    base = joined.groupBy("provider").agg(F.count("*").alias("calls"), count_if(~F.col("good")).alias("errors"), F.round(F.avg(F.col("good").cast("int")), 6).alias("success_rate"), F.round(F.coalesce(F.avg(F.when(F.col("good"), F.col("latency_ms"))), F.lit(0.0)), 6).alias("mean_latency"))
    ms = F.col("latency_ms")
    per_value = good.groupBy("provider", F.floor(F.signum(ms) * F.log2(1 + F.abs(ms)) * 64).cast("int").alias("class"), "latency_ms").agg(F.count("*").alias("c"))
    classes = per_value.groupBy("provider", "class").agg(F.sum("c").alias("c"))
    own = Window.partitionBy("provider")
    upto = classes.select("provider", "class", F.sum("c").over(own.orderBy("class")).alias("upto"), "c", F.greatest(F.floor(F.sum("c").over(own) * 0.95) - 1, F.lit(0)).alias("place"))
    hit = upto.filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c"))).select("provider", "class", (F.col("place") - F.col("upto") + F.col("c")).alias("place"))
    within = per_value.join(hit, ["provider", "class"]).withColumn("upto", F.sum("c").over(own.orderBy("latency_ms"))).filter(F.col("upto") > F.col("place"))
    p95 = within.groupBy("provider").agg(F.min("latency_ms").alias("p95_latency"))
    few = joined.filter("good").withColumn("_n", F.row_number().over(own.orderBy("asset_id"))).filter(F.col("_n") <= samples).groupBy("provider").agg(F.array_join(F.array_sort(F.collect_list("asset_id")).cast("array<string>"), ",").alias("samples"))
    return base.join(p95, "provider", "left").join(few, "provider", "left").fillna(0.0, ["p95_latency"]).fillna("", ["samples"])


def usage_summary(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_micros").alias("cost_micros"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))


def member_order() -> Column:
    """What the best of a cluster has the most of."""
    return F.struct(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("composite_score", "training_usefulness", "technical_quality", "face_quality")), (F.col("width") * F.col("height")).alias("px"), "imported_at", "asset_id")


def duplicate_clusters(assets: DataFrame) -> DataFrame:
    """Clusters of two or more live assets: type, size, best member, and the project's clusters and duplicates, sum(n - 1)."""
    clusters = assets.filter(LIVE).filter(F.col("duplicate_cluster_id").isNotNull()).groupBy("project_id", "duplicate_cluster_id").agg(F.coalesce(F.min("duplicate_type"), F.lit("unknown")).alias("type"), F.count("*").alias("n"), F.max_by("asset_id", member_order()).alias("best_id")).filter("n >= 2")
    totals = clusters.groupBy("project_id").agg(F.count("*").alias("total_clusters"), F.sum(F.col("n") - 1).alias("total_duplicates"))
    return clusters.join(totals, "project_id")


def duplicate_cluster_members(assets: DataFrame) -> DataFrame:
    """The members of each cluster with keep (its best) and score, largest clusters first, best members first."""
    clusters = duplicate_clusters(assets).select("project_id", "duplicate_cluster_id", "type", "n", "best_id")
    members = assets.filter(LIVE).join(clusters, ["project_id", "duplicate_cluster_id"])
    ordered = members.orderBy(F.desc("n"), F.desc("type"), "project_id", "duplicate_cluster_id", member_order().desc())
    return ordered.select("project_id", "duplicate_cluster_id", "type", "n", "asset_id", (F.col("asset_id") == F.col("best_id")).alias("keep"), F.coalesce("composite_score", F.lit(0.0)).alias("score"))


def export_preview(eligible: DataFrame) -> DataFrame:
    return eligible.groupBy("project_id").agg(F.count("*").alias("count"), F.count("active_caption_id").alias("captioned"), count_if(F.col("active_caption_id").isNull()).alias("uncaptioned"))


def export_validate(assets: DataFrame) -> DataFrame:
    """Warnings with their counts, over live assets."""
    n = assets.filter(LIVE).groupBy("project_id").agg(F.count("*").alias("total"), count_if(F.col("active_caption_id").isNull()).alias("uncaptioned"), count_if(F.col("review_state") == "approved").alias("approved"), count_if(F.coalesce("composite_score", F.lit(0.0)) < 0.3).alias("low"))
    rules = {"few_images": (F.col("total") < 15, "total"), "under_30": ((F.col("total") >= 15) & (F.col("total") < 30), "total"), "uncaptioned": (F.col("uncaptioned") > 0, "uncaptioned"), "none_approved": (F.col("approved") == 0, "total"), "low_quality": (F.col("low") > 0, "low")}
    rows = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("warning"), F.col(v).alias("n"))) for k, (c, v) in rules.items())))
    return n.select("project_id", F.explode(rows).alias("x")).select("project_id", "x.*")


def bucket_distribution(assets: DataFrame, side: int = 1024) -> DataFrame:
    """Assets per training bucket."""
    from quarrymill.functions.quality import training_bucket

    b = training_bucket(F.col("width"), F.col("height"), side)
    return assets.groupBy("project_id", F.concat_ws("x", b["width"], b["height"]).alias("bucket")).agg(F.count("*").alias("n"))
