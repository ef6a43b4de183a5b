"""Quality scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the composite score.
WEIGHTS = {"sharpness": 0.20, "face": 0.20, "aesthetic": 0.15, "brightness": 0.10, "contrast": 0.10, "saturation": 0.05, "centering": 0.10, "background": 0.05, "resolution": 0.05}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def composite(parts: dict[str, Column]) -> Column:
    """Weighted sum in the order of WEIGHTS, clipped to [0, 1]."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    return clip(total)


def technical(sharpness: Column, resolution: Column, noise: Column) -> Column:
    return 0.5 * sharpness + 0.3 * resolution + 0.2 * (1 - noise)


def training_value(composite_: Column, face: Column, resolution: Column) -> Column:
    return 0.7 * composite_ + 0.2 * face + 0.1 * resolution


def tier(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def overall(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def priority(useful: Column, composite_: Column, technical_: Column, face: Column) -> Column:
    return 0.45 * useful + 0.30 * composite_ + 0.15 * technical_ + 0.10 * face


def face_quality(detection: Column, area_share: Column) -> Column:
    """.5 without a face."""
    return F.when(detection.isNull(), 0.5).otherwise(0.7 * detection + 0.3 * F.least(4 * area_share, F.lit(1.0)))


def face_centering(cx: Column, cy: Column) -> Column:
    return F.when(cx.isNull(), 0.5).otherwise((clip(1 - 2 * F.abs(cx - 0.5)) + clip(1 - 2.5 * F.abs(cy - 0.4))) / 2)


def shot_type_from_ratio(face_height: Column, height: Column) -> Column:
    ratio = face_height / height
    return F.when(ratio >= 0.35, "close_up").when(ratio >= 0.12, "mid_shot").otherwise("full_body")


def pose_from_landmarks(points: Column) -> Column:
    """yaw, pitch and angle_score of a face from its points (x, y): left eye, right eye, nose and others.

    Too few points, or eyes above one another, are frontal and level with a score of 85.
    """
    x = lambda i: F.get(F.get(points, F.lit(i)), F.lit(0))
    y = lambda i: F.get(F.get(points, F.lit(i)), F.lit(1))
    apart = F.when(F.size(points) >= 5, F.nullif(F.abs(x(1) - x(0)), F.lit(0.0)))
    off = F.abs((x(2) - (x(0) + x(1)) / 2) / apart)
    drop = (y(2) - (y(0) + y(1)) / 2) / apart
    yaw = F.when(off.isNull() | (off < 0.12), "frontal").when(off < 0.30, "three_quarter").otherwise("profile")
    pitch = F.when(drop < 0.3, "looking_up").when(drop > 0.7, "looking_down").otherwise("level")
    worth = F.when(off.isNull(), 85.0).when(off < 0.12, 95 - off * 100).when(off < 0.30, 80 - off * 80).otherwise(60 - off * 40)
    return F.struct(yaw.alias("yaw"), pitch.alias("pitch"), worth.cast("int").alias("angle_score"))


def training_bucket(width: Column, height: Column, side: int = 1024) -> Column:
    """Bucket sides as multiples of 64 (halves to even, at least 64) for an area of side squared, their ratio and
    megapixels, the scale that fills the bucket, and the pixels to crop after it.

    Without a height the ratio is 1; without a width or a height, its scale is 1.
    """
    ratio = F.when(height > 0, F.try_divide(width, height)).otherwise(F.lit(1.0))
    area = F.lit(float(side * side))
    snap = lambda a: F.greatest(F.lit(64), (F.rint(F.sqrt(a) / 64) * 64).cast("int"))
    w, h = snap(area * ratio), snap(F.try_divide(area, ratio))
    fit = lambda b, x: F.when(x > 0, F.try_divide(b, x)).otherwise(F.lit(1.0))
    scale = F.greatest(fit(w, width), fit(h, height))
    crop = lambda x, b: F.greatest(F.lit(0), F.floor(x * scale).cast("int") - b)
    return F.struct(w.alias("width"), h.alias("height"), F.round(w / h, 3).alias("ar"), F.round(w * h / 1e6, 2).alias("megapixels"), F.round(scale, 3).alias("scale"), crop(width, w).alias("crop_x"), crop(height, h).alias("crop_y"))


def aspect_class(width: Column, height: Column) -> Column:
    r = F.round(width / height, 2)
    return F.when(r > 1.2, "landscape").when(r < 0.8, "portrait").otherwise("square")


def background_class(spread: Column, saturation: Column) -> Column:
    return F.when((spread < 15) & (saturation < 30), "neutral").when(spread < 30, "simple").when(spread < 60, "moderate").otherwise("busy")


def sanitize_filename(name: Column) -> Column:
    return F.translate(name, '<>:"/\\|?*\0', "__________")
