"""One analysis of each asset as a graph of stages, each a Spark job of its own; a stage that fails leaves its error and the rest goes on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.dedup import dup_phash
from quarrymill.operators.image_qc import image_features
from quarrymill.operators.tables import beside, written
from quarrymill.operators.vectors import scene_tags


@dataclass
class Stage:
    """name; columns with their types, as DDL; run, which gets what the stages that it needs have made (by name: the key
    and their columns, also of those that failed) and gives the key, these columns, and error where a row has one."""

    name: str
    columns: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


def ordered(stages: list[Stage]) -> list[Stage]:
    """The stages, each behind those that it needs."""
    done: list[Stage] = []
    left = list(stages)
    while left:
        names = {s.name for s in done}
        ready = [s for s in left if set(s.needs) <= names]
        if not ready:
            raise ValueError(f"stages that need each other, or one that isn't there: {', '.join(s.name for s in left)}")
        done += ready
        left = [s for s in left if s not in ready]
    return done


def analyse(assets: DataFrame, key: str, stages: list[Stage]) -> DataFrame:
    """assets (key and other columns) with the columns of all stages and {stage}_error of each.

    Each stage's rows are a table in the shared folder before the next begins: a lost executor costs a task, and an
    error that ends a stage's job is the error of all its rows, with no values. An asset that a stage has no row for has
    "no result". Stages give a row per key; of several, the least one is taken.
    """
    made: dict[str, DataFrame] = {}
    out = assets
    for stage in ordered(stages):
        kinds = [part.strip().split(" ", 1) for part in stage.columns.split(",")] if "<" not in stage.columns else None
        if kinds is None:
            raise ValueError(f"{stage.name}: columns of simple types only")
        names = [n for n, _ in kinds]
        failed = None
        try:
            rows = stage.run({n: made[n] for n in stage.needs})
            rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
            typed = rows.select(key, *(F.col(n).cast(t).alias(n) for n, t in kinds), F.col("error").cast("string").alias("error"))
            one = written(typed.groupBy(key).agg(F.min(F.struct(*names, "error")).alias("r")).select(key, "r.*"), f"stage-{stage.name}")
        except Exception as e:  # noqa: BLE001 - whatever ends a stage is told in its rows
            failed = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
            one = assets.select(key, *(F.lit(None).cast(t).alias(n) for n, t in kinds), F.lit(failed).alias("error"))
        made[stage.name] = one.drop("error")
        told = one.withColumn("_there", F.lit(True)).withColumnRenamed("error", "_error")
        error = F.when(F.col("_there").isNull(), F.lit(failed or "no result")).otherwise(F.col("_error"))
        out = out.join(beside(told), key, "left").withColumn(f"{stage.name}_error", error).drop("_there", "_error")
    return out


def asset_stages(key: str, images: DataFrame, faces: DataFrame, vectors: DataFrame, labels: DataFrame, assets: DataFrame) -> list[Stage]:
    """Faces (key, face), vectors (key, embedding), scene by label vectors (grp, tag, q), quality of images (key, height,
    width, channels, data) with the face's, and near hashes of assets (asset_id, project_id, phash)."""

    def face(_: dict[str, DataFrame]) -> DataFrame:
        return faces.select(key, F.col("face").alias("face_quality"), F.when(F.col("face").isNull(), "no face").alias("error"))

    def vector(_: dict[str, DataFrame]) -> DataFrame:
        return vectors.select(key, F.size("embedding").alias("dimensions"), F.when(F.col("embedding").isNull() | (F.size("embedding") <= 0), "no vector").alias("error"))

    def scene(_: dict[str, DataFrame]) -> DataFrame:
        tags = scene_tags(vectors.select(F.col(key).alias("vec_id"), "embedding"), labels, 4.0)
        return tags.select(F.col("vec_id").alias(key), "scene_class", F.col("scene_tags"), "clutter")

    def quality(made: dict[str, DataFrame]) -> DataFrame:
        f = image_features(images, key).join(beside(made["face"]), key, "left")
        score = 0.20 * F.col("sharpness") + 0.20 * F.coalesce("face_quality", F.lit(0.5)) + 0.15 * F.col("aesthetic") + 0.10 * F.col("brightness") + 0.10 * F.col("contrast") + 0.05 * F.col("saturation") + 0.05 * F.col("background") + 0.05 * F.col("resolution")
        return f.select(key, F.round(score, 6).alias("composite"), F.round("sharpness", 6).alias("sharpness"), "error")

    def duplicate(_: dict[str, DataFrame]) -> DataFrame:
        near = written(dup_phash(assets).select("asset_id", "cluster"), "near")
        none = F.when(F.col("phash").isNull(), "no hash")
        return assets.select("asset_id", "phash").join(beside(near), "asset_id", "left").select(F.col("asset_id").alias(key), F.col("cluster").alias("duplicate_of"), none.alias("error"))

    return [
        Stage("face", "face_quality double", face),
        Stage("vector", "dimensions int", vector),
        Stage("scene", "scene_class string, scene_tags string, clutter double", scene, ("vector",)),
        Stage("quality", "composite double, sharpness double", quality, ("face",)),
        Stage("duplicate", "duplicate_of long", duplicate),
    ]
