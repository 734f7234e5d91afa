"""Running means on a stream of counts, kept up to date as frames come in.

The mean of a row is over w // 2 rows on both sides, so the newest rows' means change until as many have followed.  Each
batch gives the means of its rows and of the w // 2 rows before them; the last one given for a frame is that of the
series so far, clipped at both ends as in batch.  All that is kept of a series is its last 2 * (w // 2) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.shipping import ship

STATE = "frame array<int>, n array<bigint>, size array<bigint>"


def means(n: np.ndarray, size: np.ndarray, half: int, first: int) -> np.ndarray:
    """The running means of the rows from ``first`` on."""
    total, at = np.r_[0, np.cumsum(n)], np.arange(first, len(n))
    low, high = np.maximum(0, at - half), np.minimum(len(n), at + half + 1)
    return (total[high] - total[low]).astype(float) / (size[first:] * (high - low))


def stream_smooth(fill: DataFrame, window: int = 100) -> DataFrame:
    """traj_id, frame, cluster, value: the means that a batch changed; for output mode update.

    ``fill``: traj_id, frame, cluster, n, size; frames of a series come in order, one that comes after a later one is an
    error.  Frames of one number in one batch keep their order of n.
    """
    half = max(0, window) // 2

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame, n, size = (np.array(v, dtype=np.int64) for v in (state.get if state.exists else ([], [], [])))
        parts = [[b[c].to_numpy(dtype=np.int64) for c in ("frame", "n", "size")] for b in batches]
        x = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((x[1], x[0]))  # many series have few rows each: no data frame is sorted for them
        x = [c[order] for c in x]
        if len(frame) and x[0][0] < frame[-1]:
            raise ValueError(f"frame {x[0][0]} comes after frame {frame[-1]}")
        first = max(0, len(frame) - half)
        frame, n, size = (np.concatenate([old, c]) for old, c in zip((frame, n, size), x, strict=True))
        keep = max(1, 2 * half)  # the last frame's number at least
        state.update(tuple(v[-keep:].tolist() for v in (frame, n, size)))
        if not half:  # nothing changes of what came before
            first = len(frame) - len(x[0])
        yield pd.DataFrame({"traj_id": key[0], "frame": frame[first:], "cluster": key[1], "value": means(n, size, half, first)})

    ship(fill.sparkSession)
    kind = fill.schema["traj_id"].dataType.simpleString()
    x = fill.select("traj_id", "frame", "cluster", "n", "size")
    return x.groupBy("traj_id", "cluster").applyInPandasWithState(update, f"traj_id {kind}, frame int, cluster int, value double", STATE, "update", "NoTimeout")
