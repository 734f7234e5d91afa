"""Follow running simulations: as frames come in, close windows of their series and keep each one's order of formation.

A frame is a row of a growing folder of Parquet files: which trajectory (user_id), its number (event_id), one cluster
(by event_type) and how far that is filled (value).  A run takes the files that are new since the last one, as a file
stream with a checkpoint, and ends when there are no more.  Frames and open windows are state of the stream; every full
window goes to

    windows/batch=<number of the stream's batch>/bucket=<hash of the trajectory>/

and the trajectories of the buckets that got windows are ordered anew, all their windows read, into

    orders/bucket=<hash of the trajectory>/

A batch that is repeated after a failure replaces what it wrote; a run without new files changes nothing.

    python -m jobs.follow_windows --config jobs/follow_windows.toml --events <folder> --output <folder> --checkpoint <folder>
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.columns import binary
from residua.operators.ordering import formation_order
from residua.streaming.frames import stream_windows

log = logging.getLogger(__name__)

EVENTS = "event_id bigint, user_id bigint, event_type string, value double"
WINDOWS = "traj_id bigint, cluster int, widx bigint, frame int, value double, batch bigint, bucket int"
ORDERS = "traj_id bigint, rank int, cluster int, bucket int"
CLUSTERS = 5


def frames_of(events: DataFrame) -> DataFrame:
    """A series per trajectory and cluster: traj_id (both, as text), frame, clusters (one, n hundredths of 100).

    Events without a trajectory or a number are no frames; a missing value is 0, a missing type cluster 0.
    """
    x = events.filter("user_id is not null and event_id is not null")
    cluster = F.coalesce(F.length("event_type") % CLUSTERS, F.lit(0)).cast("int")
    n = F.coalesce(F.floor(F.col("value") * 100), F.lit(0)).cast("bigint")
    one = F.struct(cluster.alias("cluster"), n.alias("n"), F.lit(100).cast("bigint").alias("size"))
    return x.select(F.concat_ws(":", "user_id", cluster).alias("traj_id"), F.col("event_id").cast("int").alias("frame"), F.array(one).alias("clusters"))


def tables(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """windows and orders as they stand."""
    return spark.read.schema(WINDOWS).parquet(f"{output}/windows"), spark.read.schema(ORDERS).parquet(f"{output}/orders")


def follow_windows(spark: SparkSession, events: str, output: str, checkpoint: str, window_size: int = 10, cutoff: float = 62.0, buckets: int = 16) -> dict[str, int]:
    """Take the events that are new; returns and logs how many were read, and windows and order rows written."""
    done = {"events": 0, "windows": 0, "orders": 0, "batches": 0}

    def replace(df: DataFrame, keys: list[str], path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

    def save(closed: DataFrame, batch: int) -> None:
        session = closed.sparkSession
        place = F.split("traj_id", ":")
        own = closed.select(place[0].cast("bigint").alias("traj_id"), "cluster", "widx", "frame", "value")
        own = own.withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": F.pmod(F.xxhash64("traj_id"), F.lit(buckets)).cast("int")})
        replace(own.repartition("bucket"), ["batch", "bucket"], f"{output}/windows")
        every = session.read.schema(WINDOWS).parquet(f"{output}/windows")
        changed = every.filter(F.col("batch") == batch).groupBy("bucket").count().collect()  # a row a bucket
        done["batches"] += 1
        done["windows"] += sum(r["count"] for r in changed)
        if changed:
            mine = every.filter(F.col("bucket").isin([r["bucket"] for r in changed]))
            order = formation_order(mine.withColumn("value", binary(F.col("value"), cutoff)), strict=False)
            order = order.withColumn("bucket", F.pmod(F.xxhash64("traj_id"), F.lit(buckets)).cast("int"))
            replace(order.repartition("bucket"), ["bucket"], f"{output}/orders")
        log.info("batch %d: %d windows in %d buckets written to %s", batch, sum(r["count"] for r in changed), len(changed), output)

    stream = spark.readStream.schema(EVENTS).parquet(events)
    windows = stream_windows(frames_of(stream), window_size)
    query = windows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["events"] = sum(p["numInputRows"] for p in query.recentProgress)
    for name, schema, keys in (("windows", WINDOWS, ["batch", "bucket"]), ("orders", ORDERS, ["bucket"])):  # without a window yet both tables are empty, but there; no file is written
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*keys).parquet(f"{output}/{name}")
    done["orders"] = tables(spark, output)[1].count()
    log.info("read %d new events from %s; wrote %d windows in %d batches; %d order rows stand in %s/orders", done["events"], events, done["windows"], done["batches"], done["orders"], output)
    return done


if __name__ == "__main__":
    from .common import main

    main(follow_windows, __doc__)
