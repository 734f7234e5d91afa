"""The whole analysis of trajectories as one lazy graph of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import formation, ordering, series


@dataclass
class Analysis:
    """What ``analyze`` derives; nothing is computed before it is used."""

    results: DataFrame
    fill: DataFrame
    q: DataFrame
    smoothed: DataFrame
    smoothed_q: DataFrame
    summary: DataFrame
    binary: DataFrame
    order: DataFrame


def analyze(frames: DataFrame, contacts: DataFrame, cutoff_distance: float = 1.2, smooth_window: int = 100, window_size: int = 10_000, cutoff: float = 0.5, strict: bool = True) -> Analysis:
    """Formed contacts once, then the parsed table, running means, float and binary summaries and the formation order.

    The counts per frame and cluster, small beside the coordinates, have several readers and are kept, on disk if need be.
    """
    results, fill, q = formation.analyzed(frames, contacts, cutoff_distance)
    fill = fill.persist(StorageLevel.MEMORY_AND_DISK)
    binary = series.summarize(fill, window_size, cutoff)
    return Analysis(results, fill, q, series.smooth(fill, smooth_window), series.smooth_q(q, smooth_window), series.summarize(fill, window_size), binary, ordering.formation_order(binary, strict))
