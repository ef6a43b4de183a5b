"""Skin tones of face patches in CIE L*a*b*, and how far they agree within a project."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From linear sRGB to XYZ over the D65 white point, and the bend of the L*a*b* curve (fixed by the standards).
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
BEND, SLOPE, SHIFT = 0.008856, 7.787, 16 / 116
#: Of a patch without pixels.
NO_TONE = (50.0, 0.0, 0.0)
#: Spreads of L, a and b that still count as one tone.
MOST_SPREAD = (8.0, 5.0, 5.0)


def lab(rgb: np.ndarray) -> np.ndarray:
    """L*a*b* of 8-bit sRGB colours (n x 3), as 8 bits too: L over 0 to 255, a and b from 128."""
    share = rgb / 255.0
    linear = np.where(share > 0.04045, ((share + 0.055) / 1.055) ** 2.4, share / 12.92)
    xyz = linear @ TO_XYZ.T / WHITE
    f = np.where(xyz > BEND, np.cbrt(xyz), SLOPE * xyz + SHIFT)
    light = np.where(xyz[:, 1] > BEND, 116 * f[:, 1] - 16, 903.3 * xyz[:, 1])
    out = np.stack([light * 255 / 100, 500 * (f[:, 0] - f[:, 1]) + 128, 200 * (f[:, 1] - f[:, 2]) + 128], axis=1)
    return np.clip(np.rint(out), 0, 255)


def patch(box: tuple[float, float, float, float], height: int, width: int) -> tuple[slice, slice]:
    """Rows and columns of the inner part of a face's box: two fifths of its sides, within the image."""
    x1, y1, x2, y2 = (int(v) for v in box)
    x, y, dx, dy = (x1 + x2) // 2, (y1 + y2) // 2, (x2 - x1) // 5, (y2 - y1) // 5
    return slice(max(0, y - dy), max(0, min(height, y + dy))), slice(max(0, x - dx), max(0, min(width, x + dx)))


def skin_tones(images: DataFrame, key: str) -> DataFrame:
    """key, l, a, b: the mean of the inner part of the face's box (x1, y1, x2, y2) of decoded images (height, width,
    channels, data in BGR), to one decimal. A box without pixels has NO_TONE; without an image or a box all are NULL."""
    kind = images.schema[key].dataType.simpleString()

    def tone(height: int, width: int, channels: int, data: bytes | None, *box: float) -> tuple[float | None, ...]:
        if data is None or not height or height < 0 or any(pd.isna(v) for v in box):
            return None, None, None
        rows, columns = patch(box, height, width)
        px = np.frombuffer(data, np.uint8).reshape(height, width, channels)[rows, columns]
        px = np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, :3]
        return tuple(round(float(v), 1) for v in lab(px.reshape(-1, 3)[:, ::-1].astype(float)).mean(axis=0)) if px.size else NO_TONE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [tone(*r) for r in rows[["height", "width", "channels", "data", "x1", "y1", "x2", "y2"]].itertuples(index=False)]
            yield pd.DataFrame({"k": rows["k"], **{n: pd.array([m[i] for m in made], "Float64") for i, n in enumerate("lab")}})

    given = images.select(F.col(key).alias("k"), "height", "width", "channels", "data", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return given.mapInPandas(run, f"k {kind}, l double, a double, b double").withColumnRenamed("k", key)


def tone_consistency(tones: DataFrame) -> DataFrame:
    """project_id, std_l, std_a, std_b (of all its tones) and consistent, of projects with two tones at least."""
    spread = tones.filter("l IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("n"), *(F.stddev_pop(c).alias(f"s_{c}") for c in "lab")).filter("n >= 2")
    same = F.lit(True)
    for c, most in zip("lab", MOST_SPREAD, strict=True):
        same = same & (F.col(f"s_{c}") < most)
    return spread.select("project_id", *(F.round(f"s_{c}", 2).alias(f"std_{c}") for c in "lab"), same.alias("consistent"))
