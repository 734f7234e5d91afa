"""The order of formation of clusters on a stream of windows, kept up to date as windows come in.

All that is kept of a trajectory is, for each cluster, whether it was formed in its last window and in the first of all,
and its latest rising edge; and what these edges were in the start window, the first with most clusters formed, which
moves on only when a window has more.  So state doesn't grow with the number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.shipping import ship

STATE = "clusters array<int>, before array<boolean>, first array<boolean>, edge array<bigint>, start array<bigint>, best int, now bigint, own array<int>, formed array<boolean>"
NONE = -1


@dataclass
class Running:
    """One trajectory's windows so far; the newest one stays open, since more of its rows may come."""

    before: dict[int, bool] = field(default_factory=dict)
    first: dict[int, bool] = field(default_factory=dict)
    edge: dict[int, int] = field(default_factory=dict)
    start: dict[int, int] = field(default_factory=dict)
    best: int = 0
    now: int = NONE
    open: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def of(cls, row: tuple) -> Running:
        clusters, before, first, edge, start, best, now, own, formed = row
        known = lambda values: {c: v for c, v in zip(clusters, values, strict=True) if v is not None and v != NONE}
        return cls(dict(zip(clusters, before, strict=True)), dict(zip(clusters, first, strict=True)), known(edge), known(start), best, now, dict(zip(own, formed, strict=True)))

    def row(self) -> tuple:
        clusters = sorted(self.before)
        return (clusters, [self.before[c] for c in clusters], [self.first.get(c, False) for c in clusters], [self.edge.get(c, NONE) for c in clusters], [self.start.get(c, NONE) for c in clusters], self.best, self.now, list(self.open), list(self.open.values()))

    def close(self) -> None:
        """Take the open window in."""
        for c, formed in self.open.items():
            if formed and self.before.get(c) is False:
                self.edge[c] = self.now
            if self.now == 0:
                self.first[c] = formed
            self.before[c] = formed
        if (n := sum(self.open.values())) > self.best:
            self.best, self.start = n, dict(self.edge)
        self.open = {}

    def add(self, widx: int, cluster: int, formed: bool) -> None:
        if widx < self.now:
            raise ValueError(f"window {widx} comes after window {self.now}")
        if widx > self.now:
            self.close()
            self.now = widx
        self.open[cluster] = self.open.get(cluster, False) or formed

    def order(self) -> list[int]:
        """The clusters in order of formation, the open window included."""
        whole = Running(dict(self.before), dict(self.first), dict(self.edge), dict(self.start), self.best, self.now, dict(self.open))
        whole.close()
        found = [c for c in whole.before if c in whole.start or whole.first.get(c)]
        return sorted(found, key=lambda c: (whole.start.get(c, 0), -c)) if whole.best else []


def stream_order(windows: DataFrame) -> DataFrame:
    """traj_id, widx, rank, cluster: after each batch the order of each trajectory that got windows, widx its newest; for output mode update.

    ``windows``: traj_id, widx, cluster, value of a binary summary, windows of a trajectory in order; several rows of one
    window may come in different batches, one of an older window is an error.  A trajectory in which none is formed has
    no rows; cluster 0 doesn't count.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Running.of(state.get) if state.exists else Running()
        rows = [r for b in batches for r in zip(b["widx"].tolist(), b["cluster"].tolist(), b["value"].tolist(), strict=True)]
        for widx, cluster, value in sorted(rows, key=lambda r: r[:2]):  # few rows a trajectory: no data frame is sorted for them
            now.add(widx, cluster, value >= 1.0)
        state.update(now.row())
        order = now.order()
        yield pd.DataFrame({"traj_id": [key[0]] * len(order), "widx": [now.now] * len(order), "rank": range(1, len(order) + 1), "cluster": order})

    ship(windows.sparkSession)
    kind = windows.schema["traj_id"].dataType.simpleString()
    x = windows.filter("cluster <> 0").select("traj_id", "widx", "cluster", "value")
    return x.groupBy("traj_id").applyInPandasWithState(update, f"traj_id {kind}, widx bigint, rank int, cluster int", STATE, "update", "NoTimeout")
