"""Image quality features: one pass over decoded images (height, width, channels, data in BGR); scores are columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("sharpness", "resolution", "brightness", "contrast", "saturation", "noise", "aesthetic", "background", "bright_share", "dark_share", "clipped_share", "levels", "empty_bins", "blockiness", "borders", "low_freq", "mid_freq", "high_freq")


def clip(x: float) -> float:
    return float(min(max(x, 0.0), 1.0))


@lru_cache(16)
def radii(height: int, width: int) -> np.ndarray:
    """How far each frequency of a shifted spectrum is from its middle, 1 at the ends of the axes."""
    y, x = np.indices((height, width))
    return np.hypot((y - height // 2) / max(height / 2, 1), (x - width // 2) / max(width / 2, 1))


def features(height: int, width: int, channels: int, data: bytes) -> dict[str, float]:
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3].astype(float)
    bgr = np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px
    grey = bgr @ np.array([0.114, 0.587, 0.299])
    inner = grey[1:-1, 1:-1]
    laplace = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * inner if min(height, width) > 2 else np.zeros(1)
    mean, most, least = grey.mean() / 255, bgr.max(2), bgr.min(2)
    saturation = np.where(most > 0, (most - least) / np.maximum(most, 1), 0).mean()
    around = sum(np.abs(grey[1 + dy : height - 1 + dy, 1 + dx : width - 1 + dx] - inner) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) if min(height, width) > 2 else np.zeros(1)
    p5, p95 = np.percentile(grey, [5, 95])
    spread = np.std(bgr.reshape(-1, 3).mean(0)) / 255
    edges = (np.abs(np.diff(grey, axis=1)) > 20).mean() if width > 1 else 0.0
    edge = max(1, min(20, height // 2, width // 2))
    rim = np.concatenate([grey[:edge].ravel(), grey[-edge:].ravel(), grey[:, :edge].ravel(), grey[:, -edge:].ravel()])
    step = np.abs(np.diff(grey, axis=0)).mean(1) if height > 1 else np.zeros(1)
    at = np.arange(7, len(step), 8)
    counts = np.bincount(grey[height // 4 : max(height * 3 // 4, height // 4 + 1), width // 4 : max(width * 3 // 4, width // 4 + 1)].astype(int).ravel(), minlength=256)
    strip = max(1, min(height, width) // 20)
    flat = sum(s.std() < 8 for s in (grey[:strip], grey[-strip:], grey[:, :strip], grey[:, -strip:]))
    power = np.abs(np.fft.fftshift(np.fft.fft2(grey)))
    radius = radii(height, width)
    total = max(power.sum(), 1e-9)
    return dict(zip(NAMES, (
        1 - 1 / (1 + laplace.var() / 300), 1 - 1 / (1 + 0.8 * height * width / 1e6), clip(1 - 2 * abs(mean - 0.45)), clip(2 * grey.std() / 255), clip(1.5 * saturation), clip(around.mean() / (255 * 9) * 10),
        clip(0.4 * (p95 - p5) / 255 + 0.3 * clip(spread * 4) + 0.3 * clip(edges * 4)), 1 / (1 + rim.var() / 500), (grey > 238).mean(), (grey < 16).mean(), ((grey == 0) | (grey == 255)).mean(),
        float((counts > 0).sum()), float((counts == 0).sum()), step[at].mean() / max(step.mean(), 1e-9) if len(at) else 0.0, float(flat), power[radius < 0.2].sum() / total, power[(radius >= 0.2) & (radius < 0.6)].sum() / total, power[radius >= 0.6].sum() / total,
    ), strict=True))


def image_features(images: DataFrame, key: str) -> DataFrame:
    """key, the features of NAMES, and error: an image that can't be measured has its reason and no features."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made, errors = [], []
            for h, w, c, d in rows[["height", "width", "channels", "data"]].itertuples(index=False):
                try:
                    made.append(features(h, w, c, d) if h and h > 0 and w > 0 else {})
                    errors.append(None if made[-1] else "undecodable")
                except (ValueError, TypeError) as e:
                    made.append({})
                    errors.append(str(e)[:200])
            yield pd.DataFrame(made, columns=list(NAMES), index=rows.index).assign(k=rows["k"], error=errors)[["k", *NAMES, "error"]]

    shape = f"k {kind}, " + ", ".join(f"{n} double" for n in NAMES) + ", error string"
    return images.select(F.col(key).alias("k"), "height", "width", "channels", "data").mapInPandas(run, shape).withColumnRenamed("k", key)

