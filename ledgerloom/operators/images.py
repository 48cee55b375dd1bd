"""Pixels of gray images as arrays, an Arrow batch at a time: thresholds, illumination, deterministic damage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType


def otsu_threshold(gray: np.ndarray) -> int:
    """The level that parts the histogram with the most variance between its sides."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, weighted = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (weighted / below - (weighted[-1] - weighted) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def local_binary(gray: np.ndarray, window: int = 41, k: float = 0.2) -> np.ndarray:
    """Black where a pixel is darker than its window's mean less a share of its deviation; sums from integral images."""
    pad = window // 2
    g = np.pad(gray.astype(float), pad, mode="reflect" if min(gray.shape) > pad else "edge")

    def box(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]

    area = window * window
    mean = box(g) / area
    deviation = np.sqrt(np.maximum(box(g * g) / area - mean * mean, 0))
    return np.where(gray > mean * (1 + k * (deviation / 128 - 1)), 255, 0).astype(np.uint8)


def even_light(gray: np.ndarray, window: int = 51) -> np.ndarray:
    """Divided by its blurred self, so that shadows go."""
    pad = window // 2
    g = np.pad(gray.astype(float), pad, mode="edge")
    s = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    blur = (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2
    return np.clip(gray / np.maximum(blur, 1) * 255, 0, 255).astype(np.uint8)


def autocontrast(gray: np.ndarray) -> np.ndarray:
    low, high = int(gray.min()), int(gray.max())
    return gray if low == high else ((gray.astype(float) - low) * 255 / (high - low)).round().astype(np.uint8)


def blue_ink(rgb: np.ndarray) -> np.ndarray:
    """Gray in which blue strokes are dark."""
    r, g, b = (rgb[..., c].astype(int) for c in range(3))
    return np.clip(255 - 2 * np.maximum(0, b - (r + g) // 2), 0, 255).astype(np.uint8)


def damage(gray: np.ndarray, kind: str, level: float, seed: int = 42) -> np.ndarray:
    """noise, shadow, crop or downscale, the same for the same seed."""
    h, w = gray.shape
    if kind == "noise":
        return np.clip(gray + np.random.default_rng(seed).normal(0, level, gray.shape), 0, 255).astype(np.uint8)
    if kind == "shadow":
        return np.clip(gray * np.linspace(1, 1 - level, w)[None, :], 0, 255).astype(np.uint8)
    if kind == "crop":
        return gray[: max(1, int(h * (1 - level))), :]
    if kind == "downscale":
        step = max(1, round(1 / level))
        return np.repeat(np.repeat(gray[::step, ::step], step, 0), step, 1)[:h, :w]
    raise ValueError(f"unknown damage {kind}")


@F.pandas_udf(IntegerType())
def otsu(pixels: pd.Series) -> pd.Series:
    """Of gray pixels as bytes."""
    return pixels.map(lambda p: otsu_threshold(np.frombuffer(p, np.uint8)) if p else None)


@F.pandas_udf(BinaryType())
def sauvola(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([local_binary(np.frombuffer(p, np.uint8).reshape(-1, w)).tobytes() for p, w in zip(pixels, width, strict=True)])


