"""Frame features: luma, content share, sharpness and average hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_hash(pixels: Column, bits: int = 64) -> Column:
    """Average hash of a flat pixel array: the first ``bits`` comparisons with the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p.cast("double")) / F.size(pixels)
    head = F.slice(pixels, 1, bits)
    flags = F.transform(head, lambda p: F.when(p.cast("double") > mean, 1).otherwise(0))
    return F.aggregate(
        flags,
        F.lit(0).cast("bigint"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")),
    )


def _one(height: int, width: int, raw: bytes) -> tuple[float, float, float]:
    grid = np.frombuffer(raw, dtype=np.uint8).reshape(height, width).astype(np.float32)
    share = float((np.abs(grid - np.median(grid)) > 30).mean())
    edge = sum(float(np.abs(np.diff(grid, 2, axis=a)).mean()) for a in (0, 1) if grid.shape[a] > 2)
    return float(grid.mean()), share, edge


def frame_features(frames: DataFrame) -> DataFrame:
    """(video_id, t, luma, frac, sharp) of decoded grey frames.

    ``frames`` has video_id, t, height, width and ``grey`` (height × width bytes);
    work is per Arrow batch, no shuffle.
    """
    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            stats = [_one(h, w, g) for h, w, g in zip(part.height, part.width, part.grey)]
            luma, frac, sharp = zip(*stats) if stats else ((), (), ())
            yield pd.DataFrame({
                "video_id": part.video_id, "t": part.t, "luma": luma, "frac": frac, "sharp": sharp,
            })
    return frames.mapInPandas(
        batches, "video_id bigint, t double, luma double, frac double, sharp double"
    )
