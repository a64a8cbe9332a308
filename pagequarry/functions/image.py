"""Differences between grey frames, as vectorised functions over binary columns of 8-bit samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType

WIDTH, HEIGHT, BLOCK = 160, 90, 8
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _blocks(samples: bytes) -> np.ndarray:
    rows, cols = HEIGHT // BLOCK, WIDTH // BLOCK
    grey = np.frombuffer(samples, np.uint8).astype(np.float64).reshape(HEIGHT, WIDTH)[: rows * BLOCK, : cols * BLOCK]
    return grey.reshape(rows, BLOCK, cols, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK * BLOCK)


def ssim_difference(first: bytes | None, second: bytes | None) -> float | None:
    """1 - the mean structural similarity over blocks of 8 x 8, within 0 and 1; null without two frames."""
    if first is None or second is None:
        return None
    a, b = _blocks(first), _blocks(second)
    mean_a, mean_b = a.mean(1), b.mean(1)
    both = ((a - mean_a[:, None]) * (b - mean_b[:, None])).mean(1)
    like = (2 * mean_a * mean_b + C1) * (2 * both + C2) / ((mean_a**2 + mean_b**2 + C1) * (a.var(1) + b.var(1) + C2))
    return float(np.clip(1 - like.mean(), 0, 1))


@F.pandas_udf(DoubleType())
def frame_difference(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([ssim_difference(a, b) for a, b in zip(first, second, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def is_blank(frame: pd.Series) -> pd.Series:
    """Whether a frame is one colour or nearly so (variance below 10)."""
    return frame.map(lambda f: bool(np.ptp(x := np.frombuffer(f, np.uint8)) == 0 or x.astype(float).var() < 10))


@F.pandas_udf(BinaryType())
def raster(text: pd.Series) -> pd.Series:
    """The bytes of a whole text spread over a frame: means over even stretches, repeats where it is short."""

    def one(t: str | None) -> bytes:
        x = np.frombuffer((t or " ").encode(), np.uint8).astype(np.float64)
        cut = np.arange(WIDTH * HEIGHT) * len(x) // (WIDTH * HEIGHT)
        until = np.maximum(np.arange(1, WIDTH * HEIGHT + 1) * len(x) // (WIDTH * HEIGHT), cut + 1)
        total = np.r_[0.0, np.cumsum(x)]
        return ((total[until] - total[cut]) / (until - cut)).astype(np.uint8).tobytes()

    return text.map(one)
