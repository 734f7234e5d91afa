"""The running order of formation against the order of the whole, window by window and as a stream that is stopped between."""

import random

import pytest
from pyspark.sql import functions as F

from residua.operators.ordering import formation_order
from residua.streaming.order import Running, stream_order

SCHEMA = "traj_id string, widx bigint, cluster int, value double"


def rows(rng, trajectories):
    out = []
    for t in range(trajectories):
        share, clusters = rng.random(), rng.sample(range(6), rng.randint(1, 5))
        out += [(f"t{t}", w, c, float(rng.random() < share)) for w in range(rng.randint(1, 9)) for c in clusters if rng.random() < 0.9]
    return out


def slow(own):
    """By the rule: the first window with most clusters, and each cluster's last rising edge up to it."""
    own = [r for r in own if r[2] != 0]
    counts = {}
    for _, w, _, v in own:
        counts[w] = counts.get(w, 0) + int(v)
    most = max(counts.values(), default=0)
    if not most:
        return []
    start, found = min(w for w, n in counts.items() if n == most), []
    for c in {r[2] for r in own}:
        mine = sorted((w, v) for _, w, k, v in own if k == c)
        edges = [w for (_, a), (w, b) in zip(mine, mine[1:]) if b and not a and w <= start]
        if edges or (0, 1.0) in mine:
            found.append((max(edges, default=0), -c))
    return [-c for _, c in sorted(found)]


def test_state_is_enough():
    rng = random.Random(1)
    for _ in range(1500):
        own, now = sorted(rows(rng, 1), key=lambda r: r[1]), Running()
        for k, (_, w, c, v) in enumerate(own):
            if c:
                now.add(w, c, bool(v))
                now = Running.of(now.row())  # as if it had been stored
                assert now.order() == slow(own[: k + 1])
    with pytest.raises(ValueError, match="window 1 comes after window 4"):
        now = Running()
        now.add(4, 1, True)
        now.add(1, 1, True)


def test_stream_that_is_stopped_between(spark, tmp_path):
    source, state, found = str(tmp_path / "windows"), str(tmp_path / "state"), {}
    windows = spark.createDataFrame(rows(random.Random(2), 30), SCHEMA)

    def save(batch, _):
        for r in batch.orderBy("rank").collect():
            if r["rank"] == 1:
                found[r["traj_id"]] = []
            found[r["traj_id"]].append(r["cluster"])

    for part in ("widx < 2", "widx = 2 and cluster < 3", "widx = 2 and cluster >= 3", "widx > 2"):
        windows.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream_order(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for r in formation_order(windows, strict=False).orderBy("traj_id", "rank").collect():
        want.setdefault(r["traj_id"], []).append(r["cluster"])
    assert found == want and len(want) > 20
