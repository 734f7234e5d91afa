"""Streams of frames: contacts, q and filling per frame, and means of full windows; their running order is in ``order``.

A stream has one row per frame (traj_id, frame, coords).  Evaluation holds no state: contacts, a small list, are looked
up in the row itself.  ``stream_windows`` is stateful: it closes a window after ``window_size`` rows of a trajectory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import distance, is_formed
from ..functions.shipping import ship

#: Contacts that are put into the plan as literals at most.
LITERAL_CONTACTS = 5_000


def stream_fill(frames: DataFrame, contacts: list[Row], cutoff: float = 1.2) -> DataFrame:
    """traj_id, frame, contacts, total, q, clusters (array of cluster, n, size); for batch frames and streams."""
    if len(contacts) > LITERAL_CONTACTS:
        raise ValueError(f"more than {LITERAL_CONTACTS} contacts; evaluate in batch")
    sizes: dict[int, int] = {}
    for c in contacts:
        sizes[c["cluster"]] = sizes.get(c["cluster"], 0) + 1
    own = F.array(*(F.struct(F.lit(int(c["i"])).alias("i"), F.lit(int(c["j"])).alias("j"), F.lit(float(c["r"])).alias("r"), F.lit(int(c["cluster"])).alias("cluster")) for c in contacts))
    ends = F.transform(own, lambda c: F.struct(c["cluster"].alias("cluster"), c["r"].alias("r"), F.try_element_at("coords", c["i"]).alias("a"), F.try_element_at("coords", c["j"]).alias("b")))
    hits = F.filter(ends, lambda c: is_formed(distance(c["a"], c["b"]), c["r"], cutoff))
    x = frames.withColumn("hits", F.explode(F.array(F.transform(hits, lambda c: F.struct(c["cluster"].alias("cluster"))))))  # found once: several columns count them
    kinds = F.array(*(F.struct(F.lit(int(k)).alias("cluster"), F.lit(n).cast("bigint").alias("size")) for k, n in sorted(sizes.items())))
    clusters = F.transform(kinds, lambda k: F.struct(k["cluster"].alias("cluster"), F.size(F.filter("hits", lambda h: h["cluster"] == k["cluster"])).cast("bigint").alias("n"), k["size"].alias("size")))
    n = F.size("hits").cast("bigint")
    return x.select("traj_id", "frame", n.alias("contacts"), F.lit(len(contacts)).cast("bigint").alias("total"), (n / F.lit(max(1, len(contacts)))).alias("q"), clusters.alias("clusters"))


def stream_windows(fill: DataFrame, window_size: int, idle: str | None = None) -> DataFrame:
    """traj_id, widx, frame, cluster, value of each full window of ``window_size`` frames in order of arrival.

    With ``idle``, say "10 minutes", a trajectory without new frames for that long ends: its last, short window is averaged
    over its real length, as in batch, and its state goes.  Without it a stream's trajectories never end, and state, a few
    counts for each, stays.
    """
    if window_size <= 0:
        raise ValueError("window_size must be positive")
    names = ["traj_id", "widx", "frame", "cluster", "value"]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def closed(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        """Whole windows' means, of rows (widx, frame, cluster, n, size)."""
        return pd.DataFrame([(key[0], widx, frame, cluster, n / size if size else float("nan")) for widx, frame, cluster, n, size in rows], columns=names)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        widx, count, first, clusters, n, size = state.get if state.exists else (0, 0, 0, [], [], [])
        sums = {c: [a, b] for c, a, b in zip(clusters, n, size, strict=True)}
        if state.hasTimedOut:
            state.remove()
            yield closed(key, [(widx, first, c, *v) for c, v in sorted(sums.items())])
            return
        done = []
        rows = [r for b in batches for r in zip(b["frame"].tolist(), b["clusters"], strict=True)]
        for frame, own in sorted(rows, key=lambda r: r[0]):  # many trajectories have few rows each: no data frame is made for them
            first = min(first, frame) if count and sums else frame
            for c in own:
                s = sums.setdefault(c["cluster"], [0, 0])
                s[0] += c["n"]
                s[1] += c["size"]
            count += 1
            if count == window_size:
                done += [(widx, first, c, *v) for c, v in sorted(sums.items())]
                widx, count, first, sums = widx + 1, 0, 0, {}
        own = sorted(sums)
        state.update((int(widx), int(count), int(first), own, [int(sums[c][0]) for c in own], [int(sums[c][1]) for c in own]))
        if wait:
            state.setTimeoutDuration(wait)
        yield closed(key, done)

    ship(fill.sparkSession)
    kind = fill.schema["traj_id"].dataType.simpleString()
    return fill.select("traj_id", "frame", "clusters").groupBy("traj_id").applyInPandasWithState(
        update, f"traj_id {kind}, widx bigint, frame int, cluster int, value double", "widx bigint, count bigint, first int, clusters array<int>, n array<bigint>, size array<bigint>", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")
