"""Running means on a stream against those of the whole series."""

import random

import numpy as np
import pytest

from residua.operators.series import smooth
from residua.streaming.smooth import means, stream_smooth

SCHEMA = "traj_id string, frame int, cluster int, n bigint, size bigint"


def test_means():
    n, size = np.array([1, 2, 3, 10]), np.array([4, 4, 4, 4])
    assert means(n, size, 1, 0).tolist() == [3 / 8, 6 / 12, 15 / 12, 13 / 8] and means(n, size, 0, 2).tolist() == [3 / 4, 10 / 4] and means(n, size, 9, 3).tolist() == [1.0]


@pytest.mark.parametrize("window", [1, 5, 8])
def test_stream_that_is_stopped_between(spark, tmp_path, window):
    rng, found = random.Random(window), {}
    rows = [(f"t{t}", f, c, rng.randint(0, 9), 9) for t in range(3) for c in (0, 2) for f in sorted(rng.sample(range(100), rng.randint(1, 40)))]
    fill, source, state = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "fill"), str(tmp_path / "state")

    def save(batch, _):
        found.update({(r["traj_id"], r["frame"], r["cluster"]): r["value"] for r in batch.collect()})

    for part in ("frame < 3", "frame >= 3 and frame < 50", "frame >= 50 and frame < 52", "frame >= 52"):
        fill.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream_smooth(spark.readStream.schema(SCHEMA).parquet(source), window).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        if part == "frame >= 3 and frame < 50":  # so far, too
            assert found == {(r["traj_id"], r["frame"], r["cluster"]): r["value"] for r in smooth(fill.filter("frame < 50"), window).collect()}
    assert found == {(r["traj_id"], r["frame"], r["cluster"]): r["value"] for r in smooth(fill, window).collect()}


def test_late_frames_are_errors(spark, tmp_path):
    source, state = str(tmp_path / "fill"), str(tmp_path / "state")

    def run():
        stream_smooth(spark.readStream.schema(SCHEMA).parquet(source), 3).writeStream.foreachBatch(lambda b, _: b.count()).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    one = lambda f: spark.createDataFrame([("t", f, 1, 1, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    one(5)
    run()
    one(4)
    with pytest.raises(Exception, match="frame 4 comes after frame 5"):
        run()
