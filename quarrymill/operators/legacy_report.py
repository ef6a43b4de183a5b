"""The older dataset report: shot shares, issues per image, recommendations, score and grade, from a table of features,
with how far faces and skin tones agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.colour import tone_consistency
from quarrymill.operators.vectors import cosine

#: Ideal shares of the shot types, and the sizes that suit the target model.
IDEAL = {"close_up": (0.20, 0.30), "mid_shot": (0.40, 0.50), "full_body": (0.20, 0.30)}
SIZE = (20, 60)
#: Fixed values, per image: severity and condition over its features.
IMAGE_ISSUES = (("high", "sharpness < 25"), ("high", "artifact < 40"), ("medium", "brightness > 230 OR brightness < 40"), ("medium", "faces > 1"), ("low", "faces > 0 AND abs(face_x - 0.5) > 0.35"), ("high", "faces = 0"))
#: Fixed values, per project: severity and condition over n, the counts below and the shots' shares.
ADVICE = (
    ("high", f"n < {SIZE[0]}"),
    ("medium", f"n > {SIZE[1]} * 1.5"),
    *(("medium", f"shots > 0 AND ({k} < {low} * shots OR {k} > {high} * shots)") for k, (low, high) in IDEAL.items()),
    ("medium", "poses < 2"),
    ("high", "no_face > n * 0.15"),
    ("high", "blurry > 0"),
    ("medium", "artifacts > 0"),
)


def weighted(rules: tuple[tuple[str, str], ...], high: int, medium: int) -> str:
    """Penalty of the rules that hold, as an expression."""
    cost = {"high": high, "medium": medium, "low": 0}
    return " + ".join(f"CASE WHEN {c} THEN {cost[s]} ELSE 0 END" for s, c in rules)


#: Per project, over images with features sharpness, artifact, brightness, faces, face_x, shot and pose.
TOTALS = {
    "n": "count(1)", **{k: f"count(CASE WHEN shot = '{k}' THEN 1 END)" for k in IDEAL}, "shots": "count(CASE WHEN shot IN ('close_up', 'mid_shot', 'full_body') THEN 1 END)", "poses": "count(DISTINCT pose)",
    "no_face": "count(CASE WHEN faces = 0 THEN 1 END)", "blurry": "count(CASE WHEN sharpness < 25 THEN 1 END)", "artifacts": "count(CASE WHEN artifact < 40 THEN 1 END)", "image_penalty": f"sum({weighted(IMAGE_ISSUES, 3, 1)})",
}
SCORE = f"greatest(0, 100 - ({weighted(ADVICE, 15, 7)}) - image_penalty)"


#: A face below this similarity to the reference is an outlier.
OUTLIER = 0.3


def identity_agreement(faces: DataFrame) -> DataFrame:
    """project_id, mean_similarity, min_similarity, max_similarity and outliers of faces (project_id, position, embedding)
    against the first face of their project; projects with one face are left out."""
    first = faces.filter("embedding IS NOT NULL").groupBy("project_id").agg(F.min_by(F.struct("position", "embedding"), "position").alias("r"))
    s = faces.join(first.select("project_id", F.col("r.position").alias("p"), F.col("r.embedding").alias("q")), "project_id").filter("position <> p")
    s = s.select("project_id", cosine(F.col("q"), F.col("embedding")).alias("s"))
    return s.groupBy("project_id").agg(F.round(F.avg("s"), 4).alias("mean_similarity"), F.round(F.min("s"), 4).alias("min_similarity"), F.round(F.max("s"), 4).alias("max_similarity"), F.count_if(F.col("s") < OUTLIER).alias("outliers"))


def legacy_dataset_report(features: DataFrame, faces: DataFrame | None = None, tones: DataFrame | None = None) -> DataFrame:
    """A row per project. With faces (project_id, position, embedding) and tones (project_id, l, a, b), also how far these
    agree (NULL where there are too few); tones that don't are one more issue of medium weight."""
    t = features.groupBy("project_id").agg(*(F.expr(x).alias(k) for k, x in TOTALS.items()))
    t = t.join(identity_agreement(faces), "project_id", "left") if faces is not None else t
    if tones is not None:
        t = t.join(tone_consistency(tones), "project_id", "left").withColumn("image_penalty", F.col("image_penalty") + F.when(~F.col("consistent"), 1).otherwise(0))
    t = t.withColumn("score", F.expr(SCORE).cast("long"))
    return t.withColumn("grade", F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 50, "C").when(F.col("score") >= 30, "D").otherwise("F"))
